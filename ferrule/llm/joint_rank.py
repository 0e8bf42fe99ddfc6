"""Problem 2: one order from several differently scaled scores, by median rank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.tables import table, written

HEAVY_ROWS, SLICES = 1_000_000, 64
#: No more lists than this are cut into slices; so many quantiles a slice reach the driver at most.
HEAVY_LISTS = 10_000


def ranks_in_lists(scores: DataFrame, by: list[str], score: str = "score", heavy_rows: int = HEAVY_ROWS, slices: int = SLICES) -> DataFrame:
    """``scores`` with list_rank: 1 + the number of rows of the same list with a larger score (equal scores share it).

    A list with more than ``heavy_rows`` rows, and more than one in ``HEAVY_LISTS`` of all rows, is cut at its own approximate score quantiles into ``slices`` ranges that
    different tasks rank; a range starts after the number of rows in the ranges above it. Within a range equal scores are counted before the shuffle and ranked as one, so
    a list of one score is no hot spot. ``scores`` is read three times: give a written table. The quantiles are the only thing that reaches the driver.
    """
    sizes = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = scores.agg((F.count(F.lit(1)) / HEAVY_LISTS).alias("share"))
    heavy = sizes.crossJoin(F.broadcast(total)).where((F.col("n") > heavy_rows) & (F.col("n") > F.col("share"))).select(*by)  # one row
    cuts = (
        scores.join(heavy, by, "left_semi").groupBy(*by)
        .agg(F.percentile_approx(score, [i / slices for i in range(1, slices)], 1000).alias("cuts")).collect()
    )
    ranked = Window.partitionBy(*by).orderBy(F.col(score).desc())
    if not cuts:
        return scores.withColumn("list_rank", F.rank().over(ranked).cast("long"))
    fixed = F.broadcast(scores.sparkSession.createDataFrame(cuts, scores.select(*by).schema.add("cuts", T.ArrayType(T.DoubleType()))))
    light = scores.join(fixed.select(*by), by, "left_anti").withColumn("list_rank", F.rank().over(ranked).cast("long"))
    sliced = scores.join(fixed, by).withColumn("slice", -F.size(F.filter("cuts", lambda c: c <= F.col(score)))).drop("cuts")
    values = sliced.groupBy(*by, "slice", score).agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = values.groupBy(*by, "slice").agg(F.sum("n").alias("n")).withColumn("start", before(Window.partitionBy(*by).orderBy("slice"))).drop("n")
    local = values.withColumn("above", before(Window.partitionBy(*by, "slice").orderBy(F.col(score).desc()))).drop("n")
    places = local.join(starts, [*by, "slice"]).withColumn("list_rank", (F.col("above") + F.col("start") + 1).cast("long")).drop("above", "start")
    return light.unionByName(sliced.join(places, [*by, "slice", score]).select(*light.columns))


def weighted_median(pairs: Column) -> Column:
    """Of an array of (value, weight) structs sorted by value: the smallest value at which half the weight is reached."""
    half = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["weight"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    return F.aggregate(
        pairs, start,
        lambda a, x: F.struct(
            (a["sum"] + x["weight"]).alias("sum"),
            F.when(a["at"].isNull() & (a["sum"] + x["weight"] >= half), x["value"]).otherwise(a["at"]).alias("at"),
        ),
    )["at"]


def joint_order(scores: DataFrame, group: str, item: str, source: str, sources: list[str], weights: dict[str, float] | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(group, item, median_rank, mean_rank, position): every item of a group in the order of its weighted median rank.

    ``scores`` has at most one row of a (group, source, item), none for a missing score. In each list the items are
    ranked by falling score, equal scores sharing a rank; an item missing from a list takes the rank behind the last
    of all the group's items. Only ranks enter, so no source counts more for its scale. Ties go to the smaller mean rank, then to the smaller item.
    Weights are 1 unless given. Null groups, items and sources, and unknown sources, are ignored.
    """
    known = scores.select(group, item, source, F.col("score").cast("double").alias("score")).where(
        F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(source).isin(sources) & F.col("score").isNotNull() & ~F.isnan("score")
    )
    ranked = ranks_in_lists(written(known), [group, source], heavy_rows=heavy_rows)
    held = ranked.groupBy(group, item).agg(*[F.max(F.when(F.col(source) == s, F.col("list_rank"))).alias(f"r{i}") for i, s in enumerate(sources)])
    members = held.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    full = held.join(members, group)
    weight = {s: float((weights or {}).get(s, 1.0)) for s in sources}
    pairs = F.array_sort(F.array(*[
        F.struct(F.coalesce(F.col(f"r{i}"), F.col("members") + 1).cast("double").alias("value"), F.lit(weight[s]).alias("weight")) for i, s in enumerate(sources)
    ]))
    total = sum(weight.values())
    scored = full.select(
        group, item, weighted_median(pairs).alias("median_rank"),
        (F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["value"] * x["weight"]) / total).alias("mean_rank"),
    )
    return scored


def first_in_order(scored: DataFrame, group: str, item: str, first: int) -> DataFrame:
    """The ``first`` items of each group with their position; a group is cut to that many in every task before the shuffle."""
    order = Window.partitionBy(group).orderBy("median_rank", "mean_rank", item)
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= first)


SCORERS = ["bm25", "ln_l2", "title_abstract", "pos", "sum_idf", "pub_date", "doc_len"]
MEASURES = ["1", "2", "3", "4", "5"]


def scorer_lists(scored_docs: DataFrame) -> DataFrame:
    """(topic, scorer, pmid, score): of each document's usable scores the latest; rows with null or NaN score are not there."""
    rows = scored_docs.select("topic", F.lower(F.trim("scorer")).alias("scorer"), "pmid", "score", "scored_at").where(
        "topic IS NOT NULL AND scorer IS NOT NULL AND pmid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)"
    )
    return rows.groupBy("topic", "scorer", "pmid").agg(F.max(F.struct("scored_at", "score")).alias("last")).select("topic", "scorer", "pmid", "last.score")


def measure_lists(features: DataFrame) -> DataFrame:
    """(topic, measure, candidate_id, score): positions 1 to 5 of scores; null, NaN or missing positions give no row.

    Of repeated rows of a candidate the larger score counts.
    """
    rows = features.where("topic IS NOT NULL AND candidate_id IS NOT NULL").select("topic", "candidate_id", F.posexplode(F.slice("scores", 1, len(MEASURES))).alias("i", "score"))
    usable = rows.where("score IS NOT NULL AND NOT isnan(score)").select("topic", (F.col("i") + 1).cast("string").alias("measure"), "candidate_id", "score")
    return usable.groupBy("topic", "measure", "candidate_id").agg(F.max("score").alias("score"))


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = scorer_lists(table(spark, sf_dir, "scored_docs"))
    return joint_order(lists, "topic", "pmid", "scorer", SCORERS).select("topic", "pmid", "median_rank", F.round("mean_rank", 6).alias("mean_rank"))


def p2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = measure_lists(table(spark, sf_dir, "learnt_features"))
    return joint_order(lists, "topic", "candidate_id", "measure", MEASURES).select("topic", "candidate_id", "median_rank", F.round("mean_rank", 6).alias("mean_rank"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = joint_order(scorer_lists(table(spark, sf_dir, "scored_docs")), "topic", "pmid", "scorer", SCORERS)
    cands = joint_order(measure_lists(table(spark, sf_dir, "learnt_features")), "topic", "candidate_id", "measure", MEASURES)
    return (
        first_in_order(docs, "topic", "pmid", 5).select(F.lit("doc").alias("kind"), "topic", F.col("pmid").alias("item_id"))
        .unionByName(first_in_order(cands, "topic", "candidate_id", 3).select(F.lit("candidate").alias("kind"), "topic", F.col("candidate_id").alias("item_id")))
    )


def _order_sql(lists: str, item: str, n: int) -> str:
    """Every item of every group against every list name: the missing ones get the rank behind the last."""
    return f"""
SELECT i.topic, i.{item}, list_sort(list(coalesce(r.rk, i.members + 1)))[{n // 2 + 1}]::DOUBLE AS median_rank, round(avg(coalesce(r.rk, i.members + 1)), 6) AS mean_rank
FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS members FROM (SELECT DISTINCT topic, {item} FROM {lists})) i
CROSS JOIN (SELECT DISTINCT list FROM {lists}) l
LEFT JOIN (SELECT *, rank() OVER (PARTITION BY topic, list ORDER BY score DESC) AS rk FROM {lists}) r
  ON r.topic = i.topic AND r.{item} = i.{item} AND r.list = l.list
GROUP BY i.topic, i.{item}"""


_DOC_LISTS = """d AS (SELECT topic, list, pmid, score FROM (
  SELECT topic, lower(trim(scorer)) AS list, pmid, score,
         row_number() OVER (PARTITION BY topic, lower(trim(scorer)), pmid ORDER BY scored_at DESC NULLS LAST, score DESC) AS r
  FROM scored_docs WHERE topic IS NOT NULL AND scorer IS NOT NULL AND pmid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) WHERE r = 1)"""
_CAND_LISTS = """c AS (SELECT topic, list, candidate_id, max(score) AS score FROM (
  SELECT topic, candidate_id, p.list, scores[p.list] AS score FROM learnt_features CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS list) p
  WHERE topic IS NOT NULL AND candidate_id IS NOT NULL) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"""

QUERIES = {"p2_found": p2_found, "p2_documents": p2_documents, "p2_candidates": p2_candidates}
ORACLES = {
    "p2_documents": f"WITH {_DOC_LISTS} {_order_sql('d', 'pmid', 7)}",
    "p2_candidates": f"WITH {_CAND_LISTS} {_order_sql('c', 'candidate_id', 5)}",
    "p2_found": f"""WITH {_DOC_LISTS}, {_CAND_LISTS}
SELECT 'doc' AS kind, topic, pmid AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY median_rank, mean_rank, pmid) AS p FROM ({_order_sql('d', 'pmid', 7)})) WHERE p <= 5
UNION ALL
SELECT 'candidate', topic, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY median_rank, mean_rank, candidate_id) AS p FROM ({_order_sql('c', 'candidate_id', 5)})) WHERE p <= 3""",
}
