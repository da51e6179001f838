"""Periodic runs of words, found with a dictionary of basic factors.

Method
    The dictionary names all factors of ``2^k`` words so that equal factors have equal names, and ``2^(k+1)`` from pairs of names.
    Only factors that occur more than once go on to the next length, so a text without long repeats costs a few levels. At every
    length the occurrences of a name are walked in order: where the next one follows within ``2^k`` words, both lie within a
    stretch of twice the factor's length, and their distance is the factor's smallest period. Neighbouring places with one
    distance form arithmetic progressions and propose that period for the stretch they cover. A run of period ``q`` with
    ``2^(k-1) < q <= 2^k`` and ``3 q`` words or more is proposed at length ``2^k`` as a whole. Proposals are extended to
    either side while words a period apart are equal; those met more than once count once.

    All texts of an Arrow batch share the arrays of one dictionary (names of words belong to a text, so no factor spans two).

Partitioning
    Texts stay where they are read; there is no shuffle, and a lost task is read again. A task holds one batch (4 MB unless the
    session sets another bound), or one text if that is larger, and about ten times that for names and places.

Defined results
    A null or empty text has no words and no runs, and collapses to an empty text. Words are the stretches between the six ASCII
    white-space characters. Null ids are returned as they came; repeated rows are separate texts. Texts of any length are
    treated whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm.common import bound_batches


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Words of all texts as numbers, no number in two texts; where each text starts; and the words by number and text."""
    ids, starts, vocabularies, base = [], [0], [], 0
    for text in texts.cast(pa.binary()):
        known: dict[bytes, int] = {}
        words = text.as_py().split() if text.is_valid else []
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)) + base)
        starts.append(starts[-1] + len(words))
        vocabularies.append(list(known))
        base += len(known)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(starts), vocabularies


def proposals(names: np.ndarray):
    """``(start, end, period)`` arrays, one set per factor length, of the stretches that progressions of occurrences cover.

    ``names`` are the names of single words.
    """
    n, span = len(names), 1
    places = np.arange(n)
    while len(places):
        # occurrences of each name in the order of the text
        order = np.argsort(names, kind="stable")
        by_name, at = names[order], places[order]
        same = by_name[1:] == by_name[:-1]
        gap = np.where(same, at[1:] - at[:-1], 0)
        close = (gap > 0) & (gap <= span)
        start, step = at[:-1][close], gap[close]
        if len(start):
            along = np.argsort(start, kind="stable")
            start, step = start[along], step[along]
            # neighbouring places with one distance
            first = np.flatnonzero(np.r_[True, (np.diff(start) != 1) | (np.diff(step) != 0)])
            last = np.r_[first[1:], len(start)] - 1
            yield start[first], start[last] + step[first] + span, step[first]
        # names of twice the length, from those that occur again
        again = np.r_[False, same] | np.r_[same, False]
        number = np.cumsum(np.r_[True, ~same]) - 1
        full = np.full(n + span, -1, dtype=np.int64)
        full[at[again]] = number[again]
        places = np.flatnonzero(full[:n] >= 0)
        left, right = full[places], full[places + span]
        both = right >= 0
        places, names = places[both], left[both] * n + right[both]
        span *= 2


def runs(names: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs with ``max(least, exponent * period)`` words or more, by start and period."""
    found = [np.zeros((0, 3), np.int64)]
    for start, end, period in proposals(names):
        # at most as much again is added below, so these can become runs
        near = end - start + 2 * period >= np.maximum(least, exponent * period)
        start, end, period = start[near], end[near], period[near]
        for side in (-1, 1):
            growing = np.arange(len(start))
            while len(growing):
                a = start[growing] - 1 if side < 0 else end[growing] - period[growing]
                b = a + period[growing]
                inside = (a >= 0) & (b < len(names))
                growing, a, b = growing[inside], a[inside], b[inside]
                growing = growing[names[a] == names[b]]
                if side < 0:
                    start[growing] -= 1
                else:
                    end[growing] += 1
        found.append(np.stack([start, end - start, period], axis=1))
    out = np.unique(np.concatenate(found), axis=0)
    out = out[out[:, 1] >= np.maximum(least, exponent * out[:, 2])]
    # a stretch that has a smaller period as well is that one's run
    order = np.lexsort((out[:, 2], out[:, 1], out[:, 0]))
    out = out[order]
    smallest = np.r_[True, (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 0)] if len(out) else np.zeros(0, bool)
    out = out[smallest]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            names, starts, words = _numbered(batch.column("text"))
            spans = runs(names, least, exponent)
            # words behind the first period of a run
            edge = np.bincount(spans[:, 0] + spans[:, 2], minlength=len(names) + 1) - np.bincount(spans[:, 0] + spans[:, 1], minlength=len(names) + 1)
            kept = np.cumsum(edge)[: len(names)] == 0
            text = np.searchsorted(starts, spans[:, 0], side="right") - 1
            spans[:, 0] -= starts[text]
            values = pa.StructArray.from_arrays([pa.array(spans[:, c]) for c in range(3)], fields=list(_SPAN))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(starts) - 1))])
            collapsed, base = [], 0
            for a, b, known in zip(starts[:-1], starts[1:], words, strict=True):
                collapsed.append(b" ".join([known[i] for i in (names[a:b][kept[a:b]] - base).tolist()]))
                base += len(known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(spark: SparkSession, docs: DataFrame, *, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs, collapsed``: every run of a text, and the text without what repeats.

    A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(least, exponent * q)`` words that
    cannot be made longer without losing that period. ``runs`` is an array of ``(start, length, period)`` by start and period;
    ``start`` counts words from 0. ``collapsed`` has the words that no run contains behind its first period, joined by a space.
    """
    if least < 2 or exponent < 3:
        raise ValueError("least must be 2 or more, exponent 3 or more")
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scan(least, exponent), f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
