"""Sinks: TREC runs, measurement and evaluation tables, feature files. Every writer is distributed unless it says ``one_file``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trec_lines(run: DataFrame) -> DataFrame:
    """(value): ``topic iteration doc_id rank score run_name``."""
    return run.select(F.concat_ws(" ", "topic", F.coalesce(F.col("iteration"), F.lit("Q0")), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), "run_name").alias("value"))


def write_run(run: DataFrame, path: str) -> None:
    trec_lines(run).write.mode("overwrite").text(path)


def _pairs(features: str | Column) -> Column:
    entries = F.array_sort(F.map_entries(features))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), " ")


def libsvm_lines(df: DataFrame) -> DataFrame:
    """(value): ``score id:value ...``, ids rising."""
    return df.select(F.concat_ws(" ", F.col("score").cast("string"), _pairs("features")).alias("value"))


def libsvm_rank_lines(df: DataFrame) -> DataFrame:
    """(value): ``score qid:topic id:value ... # comment``."""
    return df.select(F.concat_ws(" ", F.col("score").cast("string"), F.concat(F.lit("qid:"), "topic"), _pairs("features"), F.concat(F.lit("# "), F.coalesce("comment", F.lit("")))).alias("value"))


def reinforcement_lines(df: DataFrame) -> DataFrame:
    """(value): ``topic * s1 s2 ... * id:value ... # comment``; null scores are written as 0."""
    scores = F.array_join(F.transform("scores", lambda s: F.coalesce(s, F.lit(0.0)).cast("string")), " ")
    return df.select(F.concat_ws(" * ", "topic", scores, F.concat(_pairs("features"), F.lit(" # "), F.coalesce("comment", F.lit("")))).alias("value"))


def save_queries(queries: DataFrame, folder: str) -> None:
    """Parsed queries as a table, for ``readers.load_queries``."""
    queries.write.mode("overwrite").parquet(folder)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def wide(long: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row per key with a column for each of ``names``."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def write_measurements_csv(long: DataFrame, path: str, names: list[str]) -> None:
    wide(long, "topic", "name", "value", names).write.mode("overwrite").option("header", True).csv(path)


def write_measurements_json(long: DataFrame, path: str, names: list[str]) -> None:
    """One JSON object per topic: the measures by name."""
    wide(long, "topic", "name", "value", names).select("topic", F.struct(*names).alias("measurements")).write.mode("overwrite").json(path)


def evaluation_json(long: DataFrame) -> DataFrame:
    """(topic, json): a topic's measures as one JSON object with sorted names."""
    return long.groupBy("topic").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("json"))


def write_evaluation_json(long: DataFrame, path: str) -> None:
    evaluation_json(long).write.mode("overwrite").json(path)


def titles_json(extracted: DataFrame) -> DataFrame:
    """(value): every extracted document as a JSON line."""
    return extracted.select(F.to_json(F.struct("doc_id", "value")).alias("value"))


def summary_json(row: dict) -> str:
    return json.dumps(row, sort_keys=True)
