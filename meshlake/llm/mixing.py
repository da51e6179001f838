"""Mixing of sources to target weights by temperature, realised as budgeted block permutations.

Only DataFrame and SQL functions are used.

Method
    1. Tokens per source are summed (combined before the shuffle); shares ``p`` are their fractions.
    2. Weights are ``p ** alpha`` normalised. ``alpha`` lies in [0, 1] and is found by bisection: the largest one whose weights
       have at least the target entropy (as a fraction of the log of the number of sources), and not so small that a
       source would have to be repeated more than ``max_repeats`` times within the budget; the limit has precedence. The
       bisection is one higher-order expression over the array of sources (one row; one entry per source).
    3. A source's part of the budget is its weight times the budget. It is served in blocks: every full pass over the source
       is one block, a permutation of its documents by a hash of id and block number; the last block is cut where its
       running sum of tokens would pass what is left.
    4. The running sum is taken in two levels: per (source, slice of the permutation), then inside the one slice that the cut
       falls into. A source that holds most rows is thus spread over ``SLICES`` groups.

Defined results
    Null or empty texts have no tokens: they cost nothing and come with every block, the one that is cut included and
    wherever the cut falls; those of a source without any block come once. A null source is a source of its own.
    Repeated rows are documents of their own. An empty table gives an empty result. Texts of any length count whole. The cut keeps a prefix of the
    permutation whose sum does not pass what is left, so at most one document's tokens per source are missed; ties of the
    hash are broken by id, then by tokens. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch

#: Slices that a source's permutation is dealt to.
SLICES = 1024
#: Halvings of the interval of the exponent.
STEPS = 50


def word_tokens(text_col: str = "text") -> Column:
    """Runs of characters between white space: the token count that the shares are made of."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "))) + 1).cast("long")


def source_weights(docs: DataFrame, *, tokens_col: str = "tokens", source_col: str = "source", entropy: float = 0.97, max_repeats: float = 4.0, budget_share: float = 1.0) -> DataFrame:
    """``source, tokens, share, alpha, weight, budget`` of each source."""
    if not 0 < entropy <= 1 or max_repeats <= 0 or budget_share <= 0:
        raise ValueError("entropy must be in (0, 1], max_repeats and budget_share positive")
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).alias("tokens"))
    one = sums.agg(F.sort_array(F.collect_list(F.struct("tokens", "source"))).alias("s"), F.sum("tokens").alias("total"), F.sum((F.col("tokens") > 0).cast("int")).alias("n"))
    one = one.withColumn("p", F.expr("transform(filter(s, x -> x.tokens > 0), x -> x.tokens / total)"))
    norm = "aggregate(p, 0d, (a, x) -> a + pow(x, {a}))"
    # entropy of the weights p^a / z: log z - a * sum(p^a log p) / z
    ent = "(log({z}) - {a} * aggregate(p, 0d, (a, x) -> a + pow(x, {a}) * log(x)) / ({z}))".format(z=norm, a="{a}")
    most = f"(aggregate(p, 0d, (a, x) -> greatest(a, pow(x, {{a}}) / x)) / ({norm}) * {float(budget_share)}d)"

    def bisect(test: str) -> str:
        """The end of [0, 1] up to which ``test`` holds from below."""
        mid = "((i.lo + i.hi) / 2)"
        return (
            f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0d, 'hi', 1d), (i, k) -> "
            f"if({test.format(a=mid)}, named_struct('lo', {mid}, 'hi', i.hi), named_struct('lo', i.lo, 'hi', {mid}))).lo"
        )

    enough = ent + f" >= {float(entropy)}d * log(n)"
    too_often = most + f" > {float(max_repeats)}d"
    one = one.withColumn("by_entropy", F.expr(f"if({enough.format(a='1d')}, 1d, {bisect(enough)})"))
    one = one.withColumn("by_repeats", F.expr(f"if({too_often.format(a='1d')}, 1d, if({too_often.format(a='0d')}, {bisect(too_often)}, 0d))"))
    one = one.withColumn("alpha", F.greatest("by_entropy", "by_repeats")).withColumn("z", F.expr(norm.format(a="alpha")))
    each = one.select(F.explode("s").alias("x"), "total", "alpha", "z")
    return each.select(
        "x.source",
        "x.tokens",
        F.expr("if(total > 0, x.tokens / total, 0d)").alias("share"),
        "alpha",
        F.expr("if(x.tokens > 0, pow(x.tokens / total, alpha) / z, 0d)").alias("weight"),
        F.expr(f"if(x.tokens > 0, cast(floor(pow(x.tokens / total, alpha) / z * total * {float(budget_share)}d) as bigint), 0L)").alias("budget"),
    )


def _place(block: Column, id_col: str) -> Column:
    """Where a document stands in the permutation of a block: a non-negative number."""
    digest = F.md5(F.concat_ws(":", block.cast("string"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = 0.97, max_repeats: float = 4.0, budget_share: float = 1.0) -> DataFrame:
    """``doc_id, source, block, place, tokens, weight`` for each time a document is taken.

    ``block`` counts a source's passes from 0, ``place`` orders a block. The budget is ``budget_share`` times all tokens.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_tokens(text_col).alias("tokens"))
    # the texts are read once; all that follows works on three narrow columns
    rows = Scratch(docs.sparkSession, "mixing").keep(rows)
    weights = source_weights(rows, entropy=entropy, max_repeats=max_repeats, budget_share=budget_share)
    plan = weights.select(
        F.col("source").alias("s"),
        "weight",
        F.expr("if(tokens > 0, cast(floor(budget / tokens) as bigint), 0L)").alias("passes"),
        F.expr("if(tokens > 0, budget % tokens, 0L)").alias("rest"),
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # full blocks, and the last one from which a part is taken
    blocks = rows.withColumn("block", F.explode(F.expr("sequence(0L, passes)")))
    blocks = blocks.withColumn("place", _place(F.col("block"), "doc_id"))
    full = blocks.where("block < passes")
    # what costs nothing is in the last block too, if one is begun or there is no other
    free = blocks.where("block = passes and tokens = 0 and (rest > 0 or passes = 0)")
    last = blocks.where("block = passes and rest > 0 and tokens > 0").withColumn("slice", F.expr(f"place div {(1 << 60) // SLICES}"))
    slices = last.groupBy("source", "slice", "rest").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("upto", F.sum("sum").over(before)).select(
        F.col("source").alias("s"), F.col("slice").alias("l"), (F.col("upto") - F.col("sum")).alias("before"), F.expr("upto <= rest").alias("whole")
    )
    last = last.join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("l"))).where("whole or before <= rest").drop("s", "l")
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = last.where("not whole").withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).where("upto <= rest")
    columns = ["doc_id", "source", "block", "place", "tokens", "weight"]
    return full.select(*columns).unionByName(free.select(*columns)).unionByName(last.where("whole").select(*columns)).unionByName(cut.select(*columns))
