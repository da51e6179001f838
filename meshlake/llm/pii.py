"""Personal data in whole texts: candidate spans, gradient boosted trees, calibrated thresholds.

Method
    1. High-recall generators propose spans that may overlap, of four kinds: ``email``, ``ip``, ``card`` and ``phone``. The
       *base* patterns of each kind are among them; their spans are always reported. The others chain digit groups over any
       short gap of brackets, dots, dashes, slashes or blanks and propose every run of groups whose number of digits suits a
       kind, take names and hosts around spelled-out ``at`` and ``dot`` signs, and propose, inside matches of a base pattern
       that fail its check, every run of whole groups that passes it (a card behind another number, a phone before a date).
    2. Candidates that are not base spans are scored by gradient boosted regression trees (logistic loss, numpy) on features
       of the format (lengths, digit groups, gaps, checks) and of ``CONTEXT`` characters on either side.
    3. The trees are fitted on a bounded sample of texts: for each kind ``SAMPLE_OF_KIND`` texts that hold base spans of it,
       found over all data, and ``SAMPLE`` of all texts, each with the smallest hashes; of each text at most ``SPANS_OF_TEXT``
       places, and around each place ``WRONG_OF_PLACE`` wrong proposals. A base span, or more often a made-up one with a name, host or number of any style, is rewritten with other signs,
       gaps and groups or put beside another number; in what the generators then propose there, the span itself is positive
       and all else negative. Texts without base spans take made-up ones. No feature tells names or values, only forms, checks
       and context, so that the house style of the texts is not what is learnt. Negative are further all that the generators
       propose in the text as it stands outside base spans, and around dates, times, versions, prices and numbers put in.
       Examples are made in tasks; only their features reach the driver. Half of the texts calibrate one threshold per kind
       and way of proposing: the lowest score at which the precision on that half, one mistake apart, is at least ``PRECISION``.
    4. Accepted spans are added, best first, unless they overlap a base span or a better accepted span.

    No other labels of personal data exist in the tables, so the quality that the thresholds promise is that on rewritten spans.

Defined results
    Null texts count as empty and have no spans. Offsets count code points, ends are exclusive. Repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored. Texts of any length are read whole: every
    generator takes time in proportion to the text. Without any base span in the sample, only base spans are reported.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, fixed by the contract.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SAMPLE = 2000
SAMPLE_OF_KIND = 1000
SPANS_OF_TEXT = 8
#: Negative examples drawn from what is proposed around one place.
WRONG_OF_PLACE = 3
PRECISION = 0.99
CONTEXT = 24
#: Candidates of one text whose features are held at once.
PORTION = 8192
#: Words that speak for a kind when they stand just before a span.
CUES = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "pay", "credit", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
#: Words that speak against personal data: numbered things, versions, keys.
COUNTER = ("version", "v", "token", "key", "id", "no", "nr", "isbn", "sha", "build", "release")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, span: str) -> bool:
    """The check that a base match of a kind must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in span.split(".")))
    digits = _digits(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_ANY_DIGIT = re.compile("[0-9]").search


def _email_matches(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base pattern, found from the @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := BASE["email"].match(text, start)):
            yield m.start(), m.end()
            done = m.end()
            at = text.find("@", max(done, at + 1))
        else:
            at = text.find("@", at + 1)


_GROUP = re.compile("[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _ip_matches(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern: four groups at a time of each run of dotted groups."""
    for run in _DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
            for k in range(0, len(groups) - 3, 4):
                yield groups[k][0], groups[k + 3][1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _email_matches(text)]
    if _ANY_DIGIT(text):
        for kind in KINDS[1:]:
            if _SIGN[kind] in text:
                found = _ip_matches(text) if kind == "ip" else (m.span() for m in BASE[kind].finditer(text))
                out += [(kind, s, e) for s, e in found if passes(kind, text[s:e])]
    return out


#: What may stand between two digit groups of one span; three signs at most, or a spelled-out dot.
_GAP = re.compile(r"[\x20().\-/_:\[\]{}\xb7]{1,3}|\x20?[\[({]?dot[\])}]?\x20?", re.I).fullmatch
_GAP_LENGTH = 7
_AT = re.compile(r"\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20at\x20|\x20@\x20?|@\x20", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20|\.|\x20\.\x20)[A-Za-z0-9-]+)+", re.I).match
#: Groups of digits that cards are printed in.
CARD_SHAPES = ((4, 4, 4, 4), (4, 6, 5))
MOST_GROUPS = 6


def _chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Digit groups that hang together over short gaps."""
    chain: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if chain and not (m.start() - chain[-1][1] <= _GAP_LENGTH and _GAP(text, chain[-1][1], m.start())):
            yield chain
            chain = []
        chain.append(m.span())
    if chain:
        yield chain


def more_candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the further generators propose."""
    out: list[tuple[str, int, int]] = []
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < m.start() and (host := _HOST(text, m.end())):
            out.append(("email", start, host.end()))
        done = m.end()
    if not _ANY_DIGIT(text):
        return out
    for chain in _chains(text):
        for k, (first, _) in enumerate(chain):
            sizes, digits = [], 0
            for s, e in chain[k : k + MOST_GROUPS]:
                sizes.append(e - s)
                digits += e - s
                if digits > 19:
                    break
                if digits >= 13 and (tuple(sizes) in CARD_SHAPES or luhn(_digits(text[first:e]))):
                    out.append(("card", first, e))
                led = text[first] == "0" or text[max(0, first - 1) : first] in ("(", "+")
                if 7 <= digits <= 15 and 2 <= len(sizes) and (sizes[-1] in (2, 3, 4) and max(sizes) <= 5 or led and max(sizes) <= 8):
                    # brackets and signs before the first group belong to the span
                    start = first
                    while start > max(0, first - 2) and text[start - 1] in "(+":
                        start -= 1
                    out.append(("phone", start, e))
                if len(sizes) == 4 and max(sizes) <= 3:
                    gaps = [text[a[1] : b[0]] for a, b in zip(chain[k : k + 3], chain[k + 1 : k + 4], strict=True)]
                    if all("." in g or "dot" in g.lower() for g in gaps) and all(int(text[a:b]) <= 255 for a, b in chain[k : k + 4]):
                        out.append(("ip", first, e))
    return out


#: Dates written with the year in front or behind.
_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?![0-9])").search
_DIGITS_OF = {"card": (13, 19), "phone": (9, 15)}


def part_candidates(text: str) -> list[tuple[str, int, int]]:
    """Runs of whole digit groups that pass a kind's check, inside matches of its base pattern that fail it."""
    out: list[tuple[str, int, int]] = []
    if not _ANY_DIGIT(text):
        return out
    for kind in KINDS[1:]:
        if _SIGN[kind] not in text:
            continue
        # of addresses the whole run of dotted groups counts
        for m in (_DOTTED if kind == "ip" else BASE[kind]).finditer(text):
            start, end = m.span()
            if text.count(".", start, end) < 3 if kind == "ip" else passes(kind, m.group()):
                continue
            if kind == "ip" and all(passes(kind, m.group()[a:b]) for a, b in _ip_matches(m.group())):
                continue
            groups = [g.span() for g in _GROUP.finditer(text, start, end)]
            if kind == "ip":
                spans = ((groups[k][0], groups[k + 3][1]) for k in range(len(groups) - 3))
                out += [(kind, s, e) for s, e in spans if passes(kind, text[s:e])]
                continue
            least, most = _DIGITS_OF[kind]
            for k in range(len(groups) if kind == "card" else 1):
                digits = 0
                for at_group in range(k, min(k + most, len(groups))):
                    s, e = groups[at_group]
                    digits += e - s
                    if digits > most:
                        break
                    at = groups[k][0] if kind == "card" else start
                    if digits >= least and passes(kind, text[at:e]):
                        out.append((kind, at, e))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context, as numbers."""
    span = text[start:end]
    digits = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    before = re.findall(r"[a-z-]+", left.lower())
    labels = re.findall("[A-Za-z0-9-]+", _AT.split(span, maxsplit=1)[-1]) if kind == "email" else []
    labels = [x for x in labels if x.lower() != "dot"]
    last = labels[-1] if labels else ""
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(groups),
        min(groups),
        float(len(set(groups)) == 1),
        float(luhn(digits)) if digits else -1,
        float(tuple(groups) in CARD_SHAPES),
        float(tuple(groups) in CARD_SHAPES and luhn(digits)),
        float(bool(_DATE(span))),
        float(bool(_DATE(left[-14:])) or bool(_DATE(right[:14]))),
        float(last.isalpha()),
        min(len(last), 8),
        min(len(labels), 4),
        float(span[:1].isalpha()),
        sum(c in "<>" for c in span),
        float(span[:1] == "(" or span[:1] == "+"),
        float(span[:1] == "0"),
        sum(c in "()" for c in span),
        sum(c in "[]{}" for c in span),
        sum(c == "." for c in span),
        sum(c == "-" for c in span),
        sum(c == " " for c in span),
        sum(c in "/_" for c in span),
        len(gaps := re.findall("[^0-9]+", span.strip("(+"))),
        len(set(gaps)),
        max(map(len, gaps), default=0),
        float(span.startswith("00")),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(left[-1:].isalnum()),
        float(right[:1].isalnum()),
        float(left[-1:] in "\"'=:/#"),
        float(any(c in before[-3:] for c in CUES[kind])),
        float(any(c in before[-2:] for c in COUNTER)),
        len(re.findall("[0-9]", left + right)),
        len(re.search(r"(?:[0-9][\x20.-]?)*\Z", left).group()),
        len(re.match(r"(?:[\x20.-]?[0-9])*", right).group()),
    ]


class BoostedTrees:
    """Gradient boosting of small regression trees on the logistic loss, with quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 16, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[dict] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c.astype(np.float64), np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._walk(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, c, side="left").astype(np.uint8) for cuts, c in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, binned, g, h, rows, depth) -> dict:
        leaf = {"value": -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)}
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        gain, split = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        whole = total_g**2 / (total_h + self.ridge)
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            n = len(self.cuts[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            ok = (ns >= self.least) & (len(rows) - ns >= self.least)
            value = np.where(ok, gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - whole, -1)
            if len(value) and value.max() > gain:
                gain, split = value.max(), (f, int(value.argmax()))
        if split is None:
            return leaf
        f, cut = split
        low = binned[rows, f] <= cut
        return {"f": f, "cut": cut, "low": self._grow(binned, g, h, rows[low], depth - 1), "high": self._grow(binned, g, h, rows[~low], depth - 1)}

    def _walk(self, tree, binned) -> np.ndarray:
        if "value" in tree:
            return np.full(len(binned), tree["value"])
        out = np.empty(len(binned))
        low = binned[:, tree["f"]] <= tree["cut"]
        out[low], out[~low] = self._walk(tree["low"], binned[low]), self._walk(tree["high"], binned[~low])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, binned) for t in self.trees))))


class Detector:
    """Fitted trees and one threshold per kind; over 1 where nothing beyond the base spans is taken."""

    def __init__(self):
        self.trees: BoostedTrees | None = None
        self.threshold = dict.fromkeys(KINDS, 2.0)
        self.part_threshold = dict.fromkeys(KINDS, 2.0)

    def spans(self, text: str) -> tuple[list, list]:
        """``(base, added)`` spans as (kind, start, end)."""
        base = base_spans(text)
        if self.trees is None:
            return base, []
        found = more_candidates(text)
        limits = [self.threshold[kind] for kind, _, _ in found]
        parts = part_candidates(text)
        found, limits = found + parts, limits + [self.part_threshold[kind] for kind, _, _ in parts]
        if not found:
            return base, []
        p = [q for k in range(0, len(found), PORTION) for q in self.trees.predict(np.array([features(text, *c) for c in found[k : k + PORTION]], np.float32))]
        taken = Taken((s, e) for _, s, e in base)
        added = []
        for q, (kind, s, e), limit in sorted(zip(p, found, limits, strict=True), key=lambda v: (-v[0], v[1][1], v[1][2], v[1][0])):
            if q >= limit and taken.free(s, e):
                taken.add(s, e)
                added.append((kind, s, e))
        return base, added


class Taken:
    """Disjoint intervals of a text, in order."""

    def __init__(self, spans):
        self.spans: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if self.spans and s < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(e, self.spans[-1][1]))
            else:
                self.spans.append((s, e))

    def free(self, s: int, e: int) -> bool:
        k = bisect_left(self.spans, (e,))  # the first that begins at e or later
        return k == 0 or self.spans[k - 1][1] <= s

    def add(self, s: int, e: int) -> None:
        insort(self.spans, (s, e))


#: What is put between groups when a span is rewritten, and signs that stand for @ and the dot. Fixed values.
GAPS = (" ", "-", ".", "/", "_", " - ", " / ", ". ", "\xb7", "--", ":")
AT_SIGNS = (" (at) ", "(at)", "[at]", " [at] ", "{at}", " <at> ", " at ", " @ ")
IP_DOTS = ("[.]", "(.)", "{.}", " . ", ". ", " .", "[dot]", "(dot)", " dot ", " [dot] ")
PHONE_GAPS = (" ", " ", "-", "-", ".", "/", " - ", "\xb7")
DOT_SIGNS = (" (dot) ", "(dot)", "[dot]", " [dot] ", "{dot}", " dot ", ".")


def _number(rng: np.random.RandomState, k: int) -> str:
    return "".join(str(d) for d in rng.randint(0, 10, k))


def _no_card(rng: np.random.RandomState) -> str:
    """16 digits that fail the check; those that pass it by chance would be a card by every sign."""
    while luhn(digits := _number(rng, 16)):
        pass
    return digits


def _pick(rng: np.random.RandomState, options):
    return options[rng.randint(len(options))]


def _letters(rng: np.random.RandomState, low: int, high: int) -> str:
    return "".join(chr(97 + c) for c in rng.randint(0, 26, rng.randint(low, high + 1)))


def _card_number(rng: np.random.RandomState) -> str:
    """A number of one of the usual lengths that passes the check."""
    head = _pick(rng, ("3", "4", "5", "6")) + _number(rng, _pick(rng, (14, 14, 14, 13, 17)))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _made_up(rng: np.random.RandomState, kind: str) -> str:
    """A span of the base form with a name, host, number or address of any style, not only those that the texts hold."""
    if kind == "email":
        name = _pick(rng, (_letters(rng, 2, 10), f"{_letters(rng, 1, 8)}{_pick(rng, '._-+')}{_letters(rng, 2, 9)}", f"{_letters(rng, 2, 7)}{_number(rng, rng.randint(1, 5))}"))
        if rng.rand() < 0.3:
            name = name.title() if rng.rand() < 0.7 else name.upper()
        hosts = [_letters(rng, 2, 11) + (_number(rng, 1) if rng.rand() < 0.15 else "") for _ in range(_pick(rng, (1, 1, 1, 2, 2, 3)))]
        return f"{name}@{'.'.join([*hosts, _pick(rng, ('com', 'org', 'net', 'edu', _letters(rng, 2, 2), _letters(rng, 3, 4)))])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, _pick(rng, (10, 100, 256)))) for _ in range(4))
    if kind == "card":
        return _card_number(rng)
    return "+" + str(rng.randint(1, _pick(rng, (10, 100, 1000)))) + str(rng.randint(1, 10)) + _number(rng, rng.randint(7, 10))


def _grouped(rng: np.random.RandomState, digits: str) -> list[str]:
    """Digits in two to five groups of one to eight, short ones more often."""
    n, out = len(digits), []
    count = min(n, _pick(rng, (2, 2, 3, 3, 3, 4, 5)))
    cuts = sorted(rng.choice(np.arange(1, n), count - 1, replace=False))
    out = [digits[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    return out if max(map(len, out)) <= 8 and len(out[-1]) > 1 else _grouped(rng, digits)


def _rewritten(rng: np.random.RandomState, kind: str, span: str) -> str:
    """A span of the base form with other signs, gaps and groups."""
    if kind == "email":
        name, host = span.split("@")[:2]
        return name + _pick(rng, AT_SIGNS) + host.replace(".", _pick(rng, DOT_SIGNS))
    if kind == "ip":
        dot, parts = _pick(rng, IP_DOTS), span.split(".")
        dots = [dot] * 3 if rng.rand() < 0.7 else [dot if k == rng.randint(3) or rng.rand() < 0.3 else "." for k in range(3)]
        if dots == [".", ".", "."]:
            dots[rng.randint(3)] = dot
        return "".join(x for pair in zip(parts, [*dots, ""], strict=True) for x in pair)
    digits, gap = _digits(span), _pick(rng, GAPS)
    if kind == "card":
        sizes = {16: (4, 4, 4, 4), 15: (4, 6, 5)}.get(len(digits), (4,) * (len(digits) // 4) + (len(digits) % 4,))
        cuts = np.cumsum((0, *sizes))
        return gap.join(digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if digits[a:b])
    n = _pick(rng, (8, 9, 10, 10, 10))
    country, local = digits[:-n] or "1", digits[-n:]
    groups = [local[:3], local[3:6], local[6:]] if n == 10 and rng.rand() < 0.4 else _grouped(rng, local)
    gap = _pick(rng, PHONE_GAPS)
    style = rng.randint(5)
    if style == 0:
        return _pick(rng, (f"00{country}", f"+{country}/", f"{country}-", f"00{country} (0)")).rstrip() + _pick(rng, (" ", "-")) + gap.join(groups)
    if style == 1:
        return f"({_pick(rng, ('', '0'))}{groups[0]})" + _pick(rng, (" ", "", "-")) + gap.join(groups[1:])
    if style == 2:
        return "0" + groups[0] + _pick(rng, ("/", " ", "-", " / ")) + _pick(rng, (gap.join(groups[1:]), "".join(groups[1:])[:8]))
    if style == 3:
        return "0" + gap.join(groups)
    return gap.join((local[:-7], local[-7:-4], local[-4:])) if len(local) > 8 else "0" + gap.join(groups)


def _decoy(rng: np.random.RandomState, kind: str) -> str:
    """Numbers and words that look like a kind and are none: dates, times, versions, prices, references, runs of digits."""
    pick = lambda *options: options[rng.randint(len(options))]
    n = lambda a, b: str(rng.randint(a, b))
    date = pick(f"{n(1990, 2031)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2031)}", f"{n(1, 13)}/{n(1, 29)}/{n(1990, 2031)}")
    if kind == "email":
        return pick("meet", "look", "see", "arrive", "x", "sold") + pick(" at ", " (at) ", " @ ") + pick(f"{n(1, 24)}.{n(10, 60)}", f"{n(1, 99)} . {n(1, 99)}", f"the . {n(1, 9)}", f"{n(1, 9)} (dot) {n(1, 9)}")
    if kind == "ip":
        return pick("[.]", "(.)", ". ").join(n(0, 1000) for _ in range(4)) if rng.rand() < 0.7 else f"{n(0, 9)}. {n(0, 9)}. {n(10, 20)}. {n(20, 30)}"
    if kind == "card":
        gap = pick(*GAPS)
        digits = _no_card(rng)
        return pick(gap.join(digits[k : k + 4] for k in range(0, 16, 4)), f"{date} {n(10, 24)}:{n(10, 60)}:{n(10, 60)}.{_number(rng, 3)}", gap.join(_number(rng, rng.randint(2, 6)) for _ in range(4)), _number(rng, rng.randint(13, 20)))
    return pick(
        date, f"{date} {n(10, 24)}:{n(10, 60)}", f"{date} - {date}", f"{n(1, 999)}.{_number(rng, 3)}.{_number(rng, 3)}", f"{n(10, 99)} {_number(rng, 3)} {_number(rng, 3)}",
        f"978-{n(0, 9)}-{_number(rng, 2)}-{_number(rng, 6)}-{n(0, 9)}", f"{n(1990, 2031)}/{_number(rng, 4)}/{_number(rng, 4)}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}-{_number(rng, 4)}",
        f"{n(0, 90)}.{_number(rng, 4)}-{n(0, 90)}.{_number(rng, 4)}", f"{n(1, 99)}-{n(100, 999)} {n(1000, 9999)}",
    )


def _beside(rng: np.random.RandomState, kind: str) -> tuple[str, str]:
    """What stands before and after a base span so that the match as a whole fails."""
    pick = lambda *options: options[rng.randint(len(options))]
    if kind == "ip":
        return f"{rng.randint(256, 10000)}.", ""
    date = f"{rng.randint(1990, 2031)}-{rng.randint(1, 13):02}-{rng.randint(1, 29):02}"
    if kind == "phone":
        return "", pick(" ", " - ") + pick(date, f"{date} {_number(rng, 2)}", _number(rng, 8))
    return pick((_number(rng, rng.randint(1, 5)) + " ", ""), ("", " " + _number(rng, rng.randint(3, 5))), (date + " ", ""), ("", " " + date), (_number(rng, 2) + " ", " " + _number(rng, 3)), (_no_card(rng) + " ", ""))


#: Numbers of an example before its features: kind, way of proposing (1: part of a failing match), label, half of the texts.
HEAD = 4


def examples(text: str) -> Iterator[list[float]]:
    """Examples from one text, the same ones each time."""
    seed = zlib.crc32(text.encode())
    rng = np.random.RandomState(seed)
    half = float(rng.rand() < 0.5)

    def judged(whole: str, low: int, high: int, right: tuple[str, int, int] | None, kinds=KINDS):
        """Candidates that touch ``low .. high`` and no base span; positive is the one that is ``right``."""
        taken = Taken((s, e) for _, s, e in base_spans(whole))
        found = [(part, c) for part, more in ((0.0, more_candidates(whole)), (1.0, part_candidates(whole))) for c in more if c[0] in kinds and c[1] < high and c[2] > low and taken.free(c[1], c[2])]
        wrong = [k for k, (_, c) in enumerate(found) if c != right]
        drawn = set(rng.choice(wrong, min(len(wrong), WRONG_OF_PLACE), replace=False).tolist()) if wrong else set()
        for k, (part, c) in enumerate(found):
            if c == right or k in drawn:
                yield [KINDS.index(c[0]), part, float(c == right), half, *features(whole, *c)]

    places = base_spans(text)
    if len(places) > SPANS_OF_TEXT:
        places = [places[k] for k in rng.choice(len(places), SPANS_OF_TEXT, replace=False)]
    for kind, s, e in places:
        left, right = text[max(0, s - 3 * CONTEXT) : s], text[e : e + 3 * CONTEXT]
        at = len(left)
        made = [(left, _rewritten(rng, kind, text[s:e] if rng.rand() < 0.2 else _made_up(rng, kind)), right) for _ in range(2)]
        if kind != "email":
            before, after = _beside(rng, kind)
            made.append((left + before, text[s:e] if rng.rand() < 0.5 else _made_up(rng, kind), after + right))
        for a, b, c in made:
            yield from judged(a + b + c, at, len(a + b + c) - len(right), (kind, len(a), len(a + b)))
        for _ in range(2):
            decoy = _decoy(rng, kind)
            yield from judged(left + decoy + right, at, at + len(decoy), None)
    for kind in KINDS if not places else ():
        s = rng.randint(0, len(text) + 1)
        left, right, decoy = text[max(0, s - 3 * CONTEXT) : s], text[s : s + 3 * CONTEXT], " " + _decoy(rng, kind) + " "
        yield from judged(left + decoy + right, len(left), len(left) + len(decoy), None)
        # texts without base spans take made-up ones, so that there are as many in small tables
        span = _rewritten(rng, kind, _made_up(rng, kind))
        before, after = _pick(rng, (" ", ": ", ", ", " (", "\n")), _pick(rng, (" ", ", ", ".", ") ", "\n"))
        at = len(left + before)
        yield from judged(left + before + span + after + right, at, at + len(span), (kind, at, at + len(span)))
    # as the text stands: a window around a random place, and around places with digits
    spots = [m.start() for m in _GROUP.finditer(text)]
    for s in (spots[k] for k in (rng.choice(len(spots), min(len(spots), SPANS_OF_TEXT), replace=False) if spots else ())):
        low = max(0, s - 3 * CONTEXT)
        yield from judged(text[low : s + 3 * CONTEXT], s - low, s - low + 1, None)


def train(texts: list[str], *, precision: float = PRECISION) -> Detector:
    """Fit on texts: see the module's text."""
    return learn(np.array([x for text in texts for x in examples(text)], np.float32), precision=precision)


def learn(rows: np.ndarray, *, precision: float = PRECISION) -> Detector:
    """Fit on examples."""
    out = Detector()
    if len(rows) < 64:
        return out
    kinds, part, y, half, x = rows[:, 0], rows[:, 1] == 1, rows[:, 2], rows[:, 3] == 1, rows[:, HEAD:]
    if not half.any() or half.all() or not 0 < y[half].mean() < 1:
        return out
    trees = BoostedTrees().fit(x[half], y[half])
    p = trees.predict(x[~half])
    for k, kind in enumerate(KINDS):
        for of_part, threshold in ((False, out.threshold), (True, out.part_threshold)):
            mine = (kinds[~half] == k) & (part[~half] == of_part)
            q, z = p[mine], y[~half][mine]
            order = np.argsort(-q, kind="stable")
            # the first mistake is free: one in fewer than 1 / (1 - precision) examples says little
            good = np.cumsum(1 - z[order]) - 1 <= (1 - precision) * np.arange(1, len(z) + 1)
            # a score counts once all rows of that score are in
            last = np.append(q[order][1:] != q[order][:-1], True) if len(q) else np.zeros(0, bool)
            usable = np.flatnonzero(good & last)
            if len(usable) and z.sum() >= 10:
                threshold[kind] = float(max(q[order][usable[-1]], 0.5))
    out.trees = trees
    return out


def _kinds_of(batches):
    """Which kinds of base spans each text holds, as bits."""
    for batch in batches:
        bits = [sum({1 << KINDS.index(k) for k, _, _ in base_spans(v.as_py())}) for v in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(bits, pa.int32())], ["h", "kinds"])


def fit(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE, sample_of_kind: int = SAMPLE_OF_KIND) -> Detector:
    """Train on the texts with the smallest hashes: ``sample`` of those with an @ sign or a digit, ``sample_of_kind`` of each kind."""
    rows = docs.where(F.col(text_col).rlike("[@0-9]")).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # only hashes are ranked; then the texts of the chosen ones are fetched, equal texts once
    hashes = Scratch(docs.sparkSession, "pii").keep(rows.mapInArrow(_kinds_of, "h long, kinds int").distinct())
    wanted = hashes.orderBy("h").limit(sample).select("h")
    for k in range(len(KINDS)):
        wanted = wanted.unionByName(hashes.where(F.col("kinds").bitwiseAND(1 << k) != 0).orderBy("h").limit(sample_of_kind).select("h"))
    # at most sample + 4 * sample_of_kind hashes
    chosen = rows.join(F.broadcast(wanted.distinct()), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    # a bounded number of rows of numbers for each chosen text
    made = chosen.mapInArrow(_examples_of, "h long, n int, x array<float>").toArrow()
    order = np.lexsort((made.column("n").to_numpy(), made.column("h").to_numpy()))
    values = made.column("x").combine_chunks().flatten().to_numpy()
    del made
    return learn(values.reshape(len(order), -1)[order] if len(order) else np.zeros((0, HEAD), np.float32))


def _examples_of(batches):
    for batch in batches:
        for h, text in zip(batch.column("h"), batch.column("text"), strict=True):
            made = list(examples(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(made), pa.int64()), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.list_(pa.float32()))], ["h", "n", "x"])


def _line(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda v: (KINDS.index(v[0]), v[1], v[2])))


def _detect(shared):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        detector = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for value in batch.column("text"):
                base, added = detector.spans(value.as_py() or "")
                for column, kind in zip(out, KINDS, strict=False):
                    column.append(sum(k == kind for k, _, _ in base))
                out[4].append(hashlib.sha256(_line(base).encode()).hexdigest())
                out[5].append(_line(base + added))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    return run


def find(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(fit(rows))
    return rows.mapInArrow(_detect(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(spark: SparkSession, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by its kind in brackets; overlapping spans are replaced as one. Null texts stay null."""
    shared = spark.sparkContext.broadcast(fit(docs, text_col=text_col))

    def run(batches):
        detector = shared.value
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = []
            for value in batch.column(at):
                if (text := value.as_py()) is None:
                    texts.append(None)
                    continue
                base, added = detector.spans(text)
                parts, done = [], 0
                for kind, s, e in sorted(base + added, key=lambda v: (v[1], -v[2])):
                    if s >= done:
                        parts += [text[done:s], f"[{kind.upper()}]"]
                    done = max(done, e)
                texts.append("".join([*parts, text[done:]]) if base or added else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
