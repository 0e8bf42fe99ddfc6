"""Problem 6: how distinctive a term is for a record, by log-entropy weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.records import TERMS_SQL, current_records, record_terms
from ferrule.tables import table


def log_entropy(records: DataFrame, key: str = "pmid", terms: str = "terms") -> DataFrame:
    """(key, term, tf, records, weight) for every distinct term of every record.

    weight = log2(1 + tf) * (1 - H / log2 N), where H is the entropy of the term's occurrences over the records that
    hold it and N the number of records: 0 for a term spread evenly over all records, the full local weight for one of a
    single record. The first aggregation counts (record, term); the second, over its result, gives each term its
    records, its occurrences and the sum of tf * log2 tf, from which H = log2 gf - sum(tf log2 tf) / gf. Both are
    combined before the shuffle. Terms of very many records make the join back skewed; their side is split by adaptive execution.
    With one record N is 1 and the entropy factor 1. Records without terms give no row.
    """
    return _weighed(records, key, terms).drop("collection")


def _weighed(records: DataFrame, key: str, terms: str) -> DataFrame:
    """``log_entropy`` with the number of records, at least 2, as ``collection``."""
    spark = records.sparkSession
    counted = spark.sql(
        f"""SELECT `{key}` AS key, term, count(*) AS tf FROM (SELECT `{key}`, explode(`{terms}`) AS term FROM {{records}}) GROUP BY `{key}`, term""", records=records
    )
    spread = spark.sql("SELECT term, count(*) AS records, sum(tf) AS gf, sum(CASE WHEN tf > 1 THEN tf * log2(tf) ELSE 0 END) AS tlogt FROM {counted} GROUP BY term", counted=counted)
    total = records.agg(F.greatest(F.count(F.lit(1)), F.lit(2)).alias("n"))
    return spark.sql(
        f"""SELECT c.key AS `{key}`, term, c.tf, s.records, t.n AS collection,
                   log2(1 + c.tf) * (1 - (log2(s.gf) - s.tlogt / s.gf) / log2(t.n)) AS weight
            FROM {{counted}} c JOIN {{spread}} s USING (term) CROSS JOIN {{total}} t""",
        counted=counted, spread=spread, total=F.broadcast(total),  # one row
    )


def least_weight(tf: int, records: int) -> Column:
    """The least weight that a term of at least ``tf`` occurrences in a record and at most ``records`` records can have.

    The entropy of occurrences over r records is at most log2 r, so the weight is at least log2(1 + tf) * (1 - log2 r / log2 N),
    and at least 0 in a collection of no more than r records.
    """
    return math.log2(1 + tf) * F.greatest(1 - math.log2(records) / F.log2("collection"), F.lit(0.0))


def distinctive(bags: DataFrame, tf: int = 4, records: int = 8, key: str = "pmid", terms: str = "terms") -> DataFrame:
    """The rows of ``log_entropy`` that set a record apart: terms at least ``tf`` times in it and in at most ``records`` records.

    The weight finds them: none of them has less than ``least_weight``. The two counts of what it finds are then checked.
    """
    found = _weighed(bags, key, terms).where(F.col("weight") >= least_weight(tf, records) - 1e-9)
    return found.where((F.col("tf") >= tf) & (F.col("records") <= records)).drop("collection")


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_records(table(spark, sf_dir, "medline")).select("pmid", record_terms().alias("terms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive(_bags(spark, sf_dir)).select("pmid", "term")


def p6_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entropy(_bags(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_WEIGHTS_SQL = f"""
WITH {TERMS_SQL},
c AS (SELECT pmid, term, count(*) AS tf FROM (SELECT pmid, unnest(terms) AS term FROM bag) GROUP BY ALL),
s AS (SELECT term, count(*) AS records, sum(tf) AS gf FROM c GROUP BY term),
h AS (SELECT term, records, -sum((tf / gf) * log2(tf / gf)) AS entropy FROM c JOIN s USING (term) GROUP BY ALL)
SELECT pmid, term, tf, records, round(log2(1 + tf) * (1 - entropy / log2((SELECT greatest(count(*), 2) FROM cur))), 6) + 0.0 AS weight
FROM c JOIN h USING (term)"""

QUERIES = {"p6_found": p6_found, "p6_term_weights": p6_term_weights}
ORACLES = {"p6_found": f"SELECT pmid, term FROM ({_WEIGHTS_SQL}) WHERE tf >= 4 AND records <= 8", "p6_term_weights": _WEIGHTS_SQL}
