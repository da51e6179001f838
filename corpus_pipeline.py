"""A corpus pipeline: score toxicity, drop near copies, redact personal data, mix sources, pack sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``, further columns of the input included, whatever
their names: columns that a stage adds for itself get names that the input does not have.

Every stage reads whole texts, takes rows with equal ids as documents of their own, and gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import jaccard_join, mixing, packing, pii, toxicity
from meshlake.llm.common import Scratch, bound_batches, fresh, same_columns

#: SQL for the rows of ``run``; none, since SQL can express neither the recurrent network nor the trees.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer gives less than 0.3.

    Null and empty texts score below the bar and stay; equal texts share their fate; repeated rows stay repeated; rows with a
    null id are scored like any other and are not learnt from.
    """
    bound_batches(spark)
    score = fresh(docs, "score")
    network = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, network, score_col=score).where(F.col(score) < 0.3).select(*same_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the Jaccard join: the smallest id, and of equal ids one row.

    Rows are told apart by a number, so rows that share an id are compared and dropped by their own texts only, and a repeated
    row counts as a copy. Null and empty texts have no shingles and stay; so does every row with a null id.
    """
    scratch = Scratch(spark, "groups")
    number = fresh(docs, "number")
    rows = scratch.keep(docs.where("doc_id is not null").withColumn(number, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(number).alias("row"), "doc_id", "text")
    groups = jaccard_join.jaccard_components(spark, narrow.select(F.col("row").alias("doc_id"), "text"), size=5, percent=75)
    groups = scratch.keep(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("row"), "component_id"))
    members = groups.unionByName(groups.select(F.col("component_id").alias("row"), "component_id").distinct()).join(narrow.select("row", "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    gone = members.select("row").join(first, "row", "left_anti").withColumnRenamed("row", number)
    return rows.join(gone, number, "left_anti").select(*same_columns(docs)).unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; ``n_chars`` follows.

    No row goes. Null texts stay null, as does their ``n_chars``; empty texts have nothing to replace.
    """
    bound_batches(spark)
    out = pii.redact(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*same_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: none, once, or once per block.

    A null source is a source of its own. Null and empty texts cost no tokens and come with every block; repeated rows are
    taken each for itself.
    """
    number, times, copy = (fresh(docs, name) for name in ("number", "times", "copy"))
    rows = Scratch(spark, "rows").keep(docs.withColumn(number, F.monotonically_increasing_id()))
    taken = mixing.mix(rows.select(F.col(number).alias("doc_id"), "text", "source"), entropy=0.97, max_repeats=4.0, budget_share=1.0)
    counts = taken.groupBy(F.col("doc_id").alias(number)).agg(F.count("*").cast("int").alias(times))
    return rows.join(counts, number).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*same_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of at most 1024 ids.

    Null and empty texts are one piece that holds the end id; texts over 1024 ids are cut without loss; repeated rows and rows
    with a null id are packed each for itself.
    """
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.keep(out) if k + 1 < len(STAGES) else out
    return docs
