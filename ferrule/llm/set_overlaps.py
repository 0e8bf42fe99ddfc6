"""Problem 3: sizes of the overlaps between many large sets, from membership signatures. SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.tables import table, written

CHUNK = 32


def signatures(members: DataFrame, set_id: str = "hash", element: str = "pmid") -> DataFrame:
    """(sig, n): every distinct sorted array of the sets that hold an element, and the number of elements with it.

    Rows with a null set or element do not count, and repeated rows count once. The array of an element is as long as
    the number of sets that hold it, whatever the number of its rows: repeats fall away before the shuffle.
    """
    return members.sparkSession.sql(
        f"""
        SELECT sig, count(*) AS n FROM (
          SELECT array_sort(collect_set(`{set_id}`)) AS sig FROM {{members}}
          WHERE `{set_id}` IS NOT NULL AND `{element}` IS NOT NULL GROUP BY `{element}`)
        GROUP BY sig""",
        members=members,
    )


def overlaps(members: DataFrame, set_id: str = "hash", element: str = "pmid", chunk: int = CHUNK) -> DataFrame:
    """(a, b, shared, size_a, size_b), a < b: the exact overlap of every two sets that share an element.

    Elements collapse to their signature first, and the signatures, which are read three times, are written once. So a pair is written once per distinct signature, with its count as
    weight, and never once per element; the sums are combined before the shuffle. A long signature (an element of very
    many sets) is cut into chunks whose pairings are spread over all tasks. Sets without a shared element give no row:
    their overlap is 0. An empty table gives no rows.
    """
    return members.sparkSession.sql(
        f"""
        WITH s AS (SELECT * FROM {{sigs}}),
        sizes AS (SELECT id, sum(n) AS size FROM (SELECT explode(sig) AS id, n FROM s) GROUP BY id),
        chunked AS (
          SELECT n, transform(sequence(0, (size(sig) - 1) div {chunk}), i -> slice(sig, i * {chunk} + 1, {chunk})) AS chunks
          FROM s WHERE size(sig) > {chunk}),
        lefts AS (SELECT n, chunks, i, c AS l FROM chunked LATERAL VIEW posexplode(chunks) t AS i, c),
        tiles AS (
          SELECT /*+ REPARTITION */ n, l, r, i = j AS same
          FROM (SELECT n, i, l, chunks FROM lefts) LATERAL VIEW posexplode(chunks) t AS j, r WHERE j >= i),
        pairs AS (
          SELECT l AS a, r AS b, n FROM (
            SELECT n, l, rs FROM (SELECT n, sig FROM s WHERE size(sig) BETWEEN 2 AND {chunk})
            LATERAL VIEW inline(transform(sig, (x, i) -> struct(x AS l, slice(sig, i + 2, {chunk}) AS rs))) t AS l, rs)
          LATERAL VIEW explode(rs) u AS r
          UNION ALL
          SELECT a, b, n FROM (SELECT n, a, r, same FROM tiles LATERAL VIEW explode(l) t AS a) LATERAL VIEW explode(r) u AS b
          WHERE NOT same OR a < b),
        shared AS (SELECT a, b, sum(n) AS shared FROM pairs GROUP BY a, b)
        SELECT a, b, shared, x.size AS size_a, y.size AS size_b
        FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b""",
        sigs=written(signatures(members, set_id, element)),
    )


def largely_same(pairs: DataFrame, min_size: int = 50, min_share: float = 0.5) -> DataFrame:
    """Of ``overlaps``, the pairs of sets with ``min_size`` elements that share ``min_share`` of the smaller one."""
    smaller = F.least("size_a", "size_b")
    return pairs.where((smaller >= min_size) & (F.col("shared") >= min_share * smaller))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = largely_same(overlaps(table(spark, sf_dir, "clause_docs")))
    return same.select(F.col("a").alias("hash_a"), F.col("b").alias("hash_b"))


def p3_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps(table(spark, sf_dir, "clause_docs"))
    text = table(spark, sf_dir, "clauses").groupBy("hash").agg(F.min("query").alias("q"))
    named = pairs.join(text.select(F.col("hash").alias("a"), F.col("q").alias("query_a")), "a", "left").join(text.select(F.col("hash").alias("b"), F.col("q").alias("query_b")), "b", "left")
    return named.select(
        F.col("a").alias("hash_a"), F.col("b").alias("hash_b"), "query_a", "query_b", "shared", "size_a", "size_b",
        F.round(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 6).alias("jaccard"),
    )


_PAIRS_SQL = """
WITH m AS (SELECT DISTINCT hash, pmid FROM clause_docs WHERE hash IS NOT NULL AND pmid IS NOT NULL),
z AS (SELECT hash, count(*) AS size FROM m GROUP BY hash),
s AS (SELECT x.hash AS hash_a, y.hash AS hash_b, count(*) AS shared FROM m x JOIN m y ON x.pmid = y.pmid AND x.hash < y.hash GROUP BY ALL)
SELECT s.*, a.size AS size_a, b.size AS size_b FROM s JOIN z a ON a.hash = hash_a JOIN z b ON b.hash = hash_b"""

QUERIES = {"p3_found": p3_found, "p3_overlaps": p3_overlaps}
ORACLES = {
    "p3_found": f"SELECT hash_a, hash_b FROM ({_PAIRS_SQL}) WHERE least(size_a, size_b) >= 50 AND shared >= 0.5 * least(size_a, size_b)",
    "p3_overlaps": f"""
SELECT hash_a, hash_b, qa.q AS query_a, qb.q AS query_b, shared, size_a, size_b, round(shared / (size_a + size_b - shared), 6) AS jaccard FROM ({_PAIRS_SQL}) p
LEFT JOIN (SELECT hash, min(query) AS q FROM clauses GROUP BY hash) qa ON qa.hash = hash_a
LEFT JOIN (SELECT hash, min(query) AS q FROM clauses GROUP BY hash) qb ON qb.hash = hash_b""",
}
