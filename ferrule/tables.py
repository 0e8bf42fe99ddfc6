"""Reading the project's tables, and cutting lineage where an iterative operator needs it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A session in one process (master ``local[...]``), as in tests, may name none: its executors share a temporary folder. Any other
    has executors that do not see the driver's temporary folder, so it must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return tempfile.mkdtemp(prefix="ferrule-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``checkpoint_folder``."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, so later reads neither recompute it nor depend on an executor. It keeps its partitioning."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in ``shared_folder``: like ``durable``, but compressed and read by column, without its partitioning."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
