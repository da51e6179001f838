"""Token ids of a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np


def byte_letters() -> dict[str, int]:
    """The printable stand-in letter of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def token_encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """``encode(text)`` gives the ids (uint32) that the ``tokenizers`` file ``vocabulary`` gives without added special tokens.

    The file's merges are run by the quicker of two engines that agree on them; texts that hold a special token's string are
    left to the file's own tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    letters = byte_letters()
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
    # the split pattern of byte-level BPE files that name none of their own
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    found = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None

    def encode(text: str) -> np.ndarray:
        if found(text):
            return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(quick.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    return encode
