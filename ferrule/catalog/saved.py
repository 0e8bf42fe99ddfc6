"""The index of each folder of tables, built once in a session and read by all queries that rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.operators import index as ix
from ferrule.operators import scorers as sc
from ferrule.tables import shared_folder

_built: dict[tuple[str, str], sc.Collection] = {}


def collection(spark: SparkSession, sf_dir: str) -> sc.Collection:
    """The saved postings and statistics, with the current documents. The tables of a folder are taken not to change during a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        folder = shared_folder(spark)
        ix.save_index(ix.delivered_postings(spark, sf_dir), folder)
        _built[key] = sc.Collection.saved(spark, folder, ix.medline_documents(spark, sf_dir))
    return _built[key]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).postings
