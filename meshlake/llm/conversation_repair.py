"""Repair of the structure of conversations by alignment with the grammar ``(s?(ua)+)?`` of role initials.

Method
    Turns are aligned with every feasible length of the alternating string by Wagner and Fischer's table. Keeping a turn costs
    nothing, another role 3, a new empty turn 3, leaving a turn out 4; blank and repeated turns must be left out, and a truncated
    turn that stays costs 3 more. The strings of all lengths end alike (``..uaua``), so they share one table over turns and characters still to
    come; its last row holds the cost of every length. The cost of a plain script is the incumbent: by Ukkonen's bound a cell can
    only matter if the insertions and deletions that it needs stay within it, which leaves a band, and which bounds the lengths.
    A system turn in front takes the place of the string's ``s``; whichever turns stand before it are left out. For all lengths
    with the least cost the audits are traced through the table side by side, and the least in ASCII order is kept.

Partitioning
    One shuffle of the turns, by conversation; faults come from windows on that partitioning. The table sees one letter a turn
    and holds as many rows of the band as the square root of the number of turns; scripts of equal letters are worked out once a task. Texts are
    not gathered: edits meet their turns by an equi-join on (conversation, place), and a digest reads a conversation's turns one batch after the other.

Defined results
    Null roles and texts count as one space. Turns are taken by ``turn``, nulls first, equal ones by role and text; equal rows are
    kept apart (the later one is a repetition). Blank, repeated, truncated: the first of these counts. Roles go by their first character, and only
    ``s``, ``u`` and ``a`` have a place. A null conversation id is a conversation of its own. An empty table gives an empty
    result. Texts are used whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch

#: Costs of another role, a new turn, a turn left out, and a truncated turn that stays.
REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
#: What is no white space, and a text that ends a sentence, as regular expressions.
SOLID, STOPPED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: More than any cost.
_FAR = 1 << 40


def _plain(letters: str, head: bool) -> int:
    """Cost of a plain script: what is due and missing is inserted, other roles get the one that is due, and blank and repeated turns go.

    With ``head`` the first turn that stays is a system turn and keeps its place.
    """
    cost = due = made = 0
    for x in letters:
        if x == "x":
            cost += DELETE
            continue
        cost += TRUNCATED * x.isupper()
        if head:
            head = False
            continue
        made += 1
        if x.lower() == "ua"[due]:
            due = 1 - due
        elif x.lower() in "ua":
            cost += INSERT
        else:
            cost += REROLE
            due = 1 - due
    return cost + (INSERT * due if made else 2 * INSERT)


def _incumbent(letters: str) -> int:
    """The least cost of the scripts that are known beforehand."""
    stay = letters.replace("x", "")
    known = [DELETE * len(letters), _plain(letters, False)]
    return min(known + [_plain(letters, True)] if stay[:1].lower() == "s" else known)


class Table:
    """Least costs of aligning the last turns with the last characters of ``..uaua``, within a band.

    Row ``i`` holds, for every number of characters to come, the cost of the turns from ``i`` on, and the same for strings whose first
    character is the ``s`` of a system turn. Rows are worked out from the last turn back; about as many as the square root of their number
    are held at a time, the others are worked out again when the trace gets there.
    """

    def __init__(self, letters: str):
        self.letters, n = letters, len(letters)
        self.bound = _incumbent(letters)
        fixed = np.cumsum([0] + [x == "x" for x in letters[::-1]])[::-1]  # turns that must go, from each turn on
        free = np.arange(n, -1, -1) - fixed
        # what must go in any case is spent; the rest pays for insertions (more characters than turns) or deletions (fewer)
        rest = self.bound - DELETE * int(fixed[0])
        self.low, self.high = np.maximum(0, free - rest // DELETE).tolist(), (free + rest // INSERT).tolist()
        self.step = max(1, int(n**0.5))
        to_come = np.arange(self.low[n], self.high[n] + 1)
        row = (INSERT * to_come.astype(np.int64), np.full(len(to_come), _FAR, dtype=np.int64))
        self.kept, self.held = {n: row}, {}
        for i in range(n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def _reach(self, i: int, row: np.ndarray, low: int, high: int) -> np.ndarray:
        """Row ``i`` between two places; far beyond its band."""
        out = np.full(high - low + 1, _FAR, dtype=np.int64)
        a = self.low[i]
        left, right = max(low, a), min(high, a + len(row) - 1)
        if left <= right:
            out[left - low : right - low + 1] = row[left - a : right - a + 1]
        return out

    def _row(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, low, high = self.letters[i], self.low[i], self.high[i]
        to_come = np.arange(low, high + 1)
        best = self._reach(i + 1, after[0], low, high) + DELETE
        ahead = self._reach(i + 1, after[1], low, high) + DELETE
        if x != "x":
            # with an odd number of characters to come an a is due, with an even number a u
            wrong = x.lower() != np.where(to_come % 2 == 1, "a", "u")
            stay = self._reach(i + 1, after[0], low - 1, high - 1) + REROLE * wrong + TRUNCATED * x.isupper()
            best = np.minimum(best, np.where(to_come > 0, stay, _FAR))
            if x in "sS":
                ahead = np.minimum(ahead, self._reach(i + 1, after[0], low - 1, high - 1) + TRUNCATED * x.isupper())
        # insertions run along the row: the least of best[j] + INSERT * (r - j) over j <= r
        return np.minimum.accumulate(best - INSERT * to_come) + INSERT * to_come, ahead

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ``i``; those up to the next stored one are worked out together."""
        if i in self.kept:
            return self.kept[i]
        if i not in self.held:
            last = min(len(self.letters), (i // self.step + 1) * self.step)
            row, self.held = self.kept[last], {}
            for k in range(last - 1, i - 1, -1):
                row = self.held[k] = self._row(k, row)
        return self.held[i]

    def least(self) -> tuple[int, str]:
        """The least cost over all lengths, and the least audit among those of that cost.

        The audits of all lengths with that cost are traced side by side: as long as they agree they are at the same turn and
        differ only in the characters to come, and those that could take a smaller letter go on alone.
        """
        plain, ahead = self.row(0)
        to_come = np.arange(self.low[0], self.low[0] + len(plain))
        # pairs, or a system turn and one pair at least
        plain, ahead = np.where(to_come % 2 == 0, plain, _FAR), np.where((to_come % 2 == 1) & (to_come > 1), ahead, _FAR)
        cost = int(min(plain.min(initial=_FAR), ahead.min(initial=_FAR)))
        # characters to come, whether the system turn is still to be kept, and the cost of what is left
        r = np.concatenate([to_come[plain == cost], to_come[ahead == cost]])
        head = np.concatenate([np.zeros((plain == cost).sum(), bool), np.ones((ahead == cost).sum(), bool)])
        left = np.full(len(r), cost, dtype=np.int64)
        out, i, n = [], 0, len(self.letters)
        while i < n or r.any():
            options = []
            if i < n:
                x = self.letters[i]
                after = self.row(i + 1)
                here = lambda k, h: np.where(h, self._at(i + 1, after[1], k), self._at(i + 1, after[0], k))  # noqa: B023, E731
                options.append(("D", DELETE, here(r, head), r, head, np.ones(len(r), bool)))
            options.append(("I", INSERT, self._at(i, self.row(i)[0], r - 1), r - 1, head, ~head & (r > 0)))
            if i < n and x != "x":
                more = TRUNCATED * x.isupper()
                fits = np.where(head, x in "sS", (r > 0) & (x.lower() == np.where(r % 2 == 1, "a", "u")))
                none = np.zeros(len(r), bool)
                options.append(("K", more, here(r - 1, none), r - 1, none, fits))
                options.append(("R", more + REROLE, here(r - 1, none), r - 1, none, ~head & ~fits & (r > 0)))
            for letter, price, then, to, still, allowed in options:
                good = allowed & (left == then + price)
                if good.any():
                    out.append(letter)
                    r, head, left = to[good], still[good], then[good]
                    i += letter != "I"
                    break
        return cost, "".join(out)

    def _at(self, i: int, row: np.ndarray, r: np.ndarray) -> np.ndarray:
        k = r - self.low[i]
        inside = (k >= 0) & (k < len(row))
        return np.where(inside, row[np.where(inside, k, 0)], _FAR)


@lru_cache(maxsize=20_000)
def repair_script(letters: str) -> tuple[int, str]:
    """``(cost, audit)`` of the cheapest edits, for one letter a turn.

    ``s, u, a`` for these roles and ``o`` for others, a capital for truncated turns, ``x`` for those that must go.
    """
    return Table(letters).least()


def edits(letters: str, audit: str) -> tuple[list[int], list[str | None]]:
    """For each repaired turn: the turn that it comes from (-1: none), and its role where that is a new one."""
    used, roles, i, due = [], [], 0, 0
    for e in audit:
        if e != "D":
            used.append(-1 if e == "I" else i)
            roles.append(None if e == "K" else ("user", "assistant")[due])
            # a system turn stands in front and leaves a user due
            due = 0 if e == "K" and letters[i].lower() == "s" else 1 - due
        i += e != "I"
    return used, roles


def _scripts(letters: pd.Series) -> pd.DataFrame:
    scripts = [repair_script(x) for x in letters]
    moves = [edits(x, audit) for x, (_, audit) in zip(letters, scripts, strict=True)]
    return pd.DataFrame({"cost": [c for c, _ in scripts], "audit": [a for _, a in scripts], "used": [u for u, _ in moves], "roles": [r for _, r in moves]})


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conversations, repaired)``: what was found and done, and the repaired turns.

    ``conversations(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit)`` has one row per conversation: ``gaps`` counts
    missing turn numbers, ``illegal`` neighbours that the grammar does not allow, ``blank``, ``duplicate`` and ``truncated`` turns with
    that fault; ``audit`` has one letter per edit (Keep, Rerole, Delete, Insert) in order. ``repaired(conv_col, place, role, text)`` has
    one row per turn of the repaired conversation, with places from 0; a conversation without turns has none.
    """
    scratch = Scratch(turns.sparkSession, "repair")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # all windows are on (conv, ..) and share one exchange
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    start = F.substring("role", 1, 1)
    pair = F.concat(F.lag(start).over(order), start)
    last = F.lag("turn").over(order)
    rows = rows.select(
        "*", F.row_number().over(order).alias("place"), start.alias("initial"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & (last.isNull() | (last != F.col("turn")))).alias("fresh"),
    )
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1
    fault = F.when(~F.col("text").rlike(SOLID), "b").when(again, "d").when(~F.col("text").rlike(STOPPED), "t").otherwise("")
    own = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(own)).otherwise(own)
    rows = scratch.keep(rows.withColumn("fault", fault).withColumn("letter", letter).drop("initial"))
    count = lambda kind: F.sum((F.col("fault") == kind).cast("long"))
    # of the turns themselves only letters are gathered
    held = rows.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "letter"))), lambda t: t["letter"]), "").alias("letters"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("fresh").cast("long")), F.lit(0).cast("long")).alias("gaps"),
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), F.sum(F.col("illegal").cast("long")).alias("illegal"),
    )
    scripts = F.pandas_udf(_scripts, "cost long, audit string, used array<int>, roles array<string>")
    done = scratch.keep(held.withColumn("script", scripts("letters")).drop("letters"))
    made = done.select("conv", F.posexplode(F.arrays_zip("script.used", "script.roles")).alias("at", "e")).select("conv", "at", F.col("e.used").alias("used"), F.col("e.roles").alias("due"))
    made = made.withColumn("own", F.col("used") + 1)
    known = rows.select(F.col("conv").alias("c"), F.col("place").alias("p"), "role", "text")
    made = made.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("own") == F.col("p")), "left")
    repaired = made.select(F.col("conv").alias(conv_col), F.col("at").alias("place"), F.coalesce("due", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return done.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "script.cost", "script.audit"), repaired


def _digests(batches):
    """Rows sorted by conversation and place as one SHA-256 per conversation of its lines ``role:text``."""
    now, digest = None, None
    keys, out = [], []

    def close() -> None:
        if digest is not None:
            keys.append(now)
            out.append(digest.hexdigest())

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if digest is None or conv != now:
                close()
                now, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("conv").type), pa.array(out)], ["conv", "digest"])
            keys, out = [], []
        kind = batch.schema.field("conv").type
    close()
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out)], ["conv", "digest"])


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, repaired_sha256`` of the lines ``role:text`` of repaired turns, joined by line feeds.

    A conversation's turns pass through one task in their order, as such a digest demands; the task holds one batch of them.
    """
    rows = repaired.select(F.col(conv_col).alias("conv"), "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "place")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(_digests, f"conv {kind}, digest string").select(F.col("conv").alias(conv_col), F.col("digest").alias("repaired_sha256"))
