"""Diagnostics that follow arriving model output on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from meshlake.operators.mesh import large


def stream_fields(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def region_sums(field: DataFrame, cells: DataFrame, value: str = "temp") -> DataFrame:
    """``region, year, total, weight`` of a (streaming) field joined with the static ``cells(node, region, w_A)``.

    The ratio is taken after the aggregation, so the state is two sums per region and year.
    """
    valid = F.col(value).isNotNull()
    joined = large(field).join(cells, "node")
    return joined.groupBy("region", F.year("time").alias("year")).agg(F.sum(F.col(value) * F.col("w_A")).alias("total"), F.sum(F.when(valid, F.col("w_A"))).alias("weight"))


def stream_region_index(field: DataFrame, cells: DataFrame, name: str, checkpoint: str, value: str = "temp") -> StreamingQuery:
    """Running index per region and year as a table in memory, updated with every batch of files."""
    sums = region_sums(field, cells, value)
    return sums.select("region", "year", (F.col("total") / F.col("weight")).alias(value)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def write_updates(batch: DataFrame, batch_id: int, target: str) -> None:
    """Store the rows that a batch has changed below ``batch=<id>``; a repeated batch replaces its own folder."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def latest(spark: SparkSession, target: str, keys: list[str], schema: str) -> DataFrame:
    """The last state of every key among the stored updates; ``schema`` is that of an update."""
    known = spark.read.schema(f"{schema}, batch long").option("basePath", target).parquet(f"{target}/batch=*")
    return _last(known, keys)


def _last(updates: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def stream_region_updates(field: DataFrame, cells: DataFrame, target: str, checkpoint: str, value: str = "temp") -> StreamingQuery:
    """Running sums per region and year: every batch stores only the keys that it has changed, in update mode.

    ``region, year, total, weight`` are sums since the start, so of several rows of a key the one of the last batch holds, and a batch that is
    repeated after a failure writes the same rows to the same folder. ``latest`` reads the state; the ratio is taken there.
    """
    sums = region_sums(field, cells, value)
    return sums.writeStream.outputMode("update").foreachBatch(lambda batch, number: write_updates(batch, number, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, target: str, keys: list[str], schema: str, below: int) -> None:
    """Put the updates of all batches below a number into one folder, that of the highest of them, and delete the others.

    The new folder is written first under a name that no reader lists, ``_compacted``, then takes the place of the highest one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)]
    old = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and int(n.split("=")[1]) < below)
    if len(old) < 2:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    known = spark.read.schema(f"{schema}, batch long").option("basePath", target).parquet(*(f"{target}/batch={n}" for n in old))
    _last(known, keys).write.mode("overwrite").parquet(f"{target}/_compacted")
    files.delete(hadoop(f"{target}/batch={old[-1]}"), True)
    files.rename(hadoop(f"{target}/_compacted"), hadoop(f"{target}/batch={old[-1]}"))
    for n in old[:-1]:
        files.delete(hadoop(f"{target}/batch={n}"), True)


def daily_sums(events: DataFrame, time: str = "ts", late: str = "30 days") -> DataFrame:
    """``station, variable, day, total, n``: partial sums per day; rows later than the watermark are dropped."""
    day = F.window(time, "1 day")
    out = events.withWatermark(time, late).groupBy(day, "station", "variable").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return out.select("station", "variable", F.col("window.start").alias("day"), "total", "n")


def monthly_means(daily: DataFrame) -> DataFrame:
    """Monthly means from stored daily sums: streaming windows have no calendar units."""
    return daily.groupBy("station", "variable", F.date_trunc("month", "day").alias("month")).agg((F.sum("total") / F.sum("n")).alias("mean"))


def recompute_years(batch: DataFrame, field: DataFrame, diagnose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``diagnose`` of all rows of ``field`` in the years that ``batch`` touches.

    The years of a batch are a few numbers, so they are broadcast.
    """
    years = batch.select(F.year("time").alias("year")).distinct()
    rows = field if "year" in field.columns else field.withColumn("year", F.year("time"))
    return diagnose(rows.join(F.broadcast(years), "year", "left_semi"))


def stream_recompute(field: DataFrame, source: str, target: str, checkpoint: str, diagnose: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Recompute a diagnostic for the years that a batch touches and replace their partitions: repeating a batch changes nothing.

    ``diagnose`` takes the rows of those years of the folder ``source`` and returns rows with a ``year``. A source partitioned
    by ``year`` is read only where a batch touches it.
    """

    def each(batch: DataFrame, _: int) -> None:
        field = batch.sparkSession.read.schema(batch.schema).parquet(source)
        if "year" in field.columns:
            # the years as literals, a few numbers, so that only their folders are read
            touched = batch.where("time is not null").select(F.year("time")).distinct().collect()
            field = field.where(F.col("year").isin([r[0] for r in touched]))
        recompute_years(batch, field, diagnose).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(target)

    return field.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
