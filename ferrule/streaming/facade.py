"""Structured Streaming over the same operators: streams of queries against static postings, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import scorers as sc
from ferrule.tables import shared_folder


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the files of a parquet table, its schema read once from the files."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    parent, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:  # a file, not a folder: a stream reads folders
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, keys, n, total): tumbling, or with ``slide`` sliding, windows; rows later than ``late`` after the newest are dropped by the watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(key, session_start, n): runs of a key's events with gaps below ``gap``.

    Events later than ``late`` are dropped by the watermark, in complete mode too; None keeps all, for bounded replays in complete mode.
    """
    s = (events if late is None else events.withWatermark(time, late)).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), "n")


def matched_stream(terms: DataFrame, collection: sc.Collection, fields: list[str]) -> DataFrame:
    """(topic, term, field, doc_id, tf, pos) for a stream of (topic, term): a stream-static join without state."""
    return terms.join(collection.postings.where(F.col("field").isin(fields)), "term")


def score_each_batch(terms: DataFrame, score: Callable[[DataFrame], DataFrame], path: str):
    """A writer that scores every micro-batch of query terms with an ordinary batch plan and appends the result to ``path``."""

    def one(batch: DataFrame, epoch: int) -> None:
        score(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return terms.writeStream.foreachBatch(one)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream run over all that is there, its output written to the shared folder and read back. Complete mode keeps the last batch."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/epoch={epoch}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.drop("epoch") if "epoch" not in stream.columns else out
