"""Normalising and merging ranked lists (list_id, topic, doc_id, score)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators import scorers as sc
from ferrule.plans.ast import ABSTRACT, ALL, MESH_FIELDS, TEXT, TITLE, Boolean, Keyword, Node, keywords
from ferrule.tables import written

KEYS = ["topic", "list_id"]


def min_max(lists: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scores of each list scaled to [0, 1]; a list with a single value gets 0. Two small aggregates are joined back, so no list is sorted or held."""
    ends = lists.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return lists.join(ends, keys).withColumn("score", scaled).drop("lo", "hi")


def comb_sum(lists: DataFrame) -> DataFrame:
    return lists.groupBy("topic", "doc_id").agg(F.sum("score").alias("score"))


def comb_mnz(lists: DataFrame) -> DataFrame:
    """The sum of a document's scores times the number of lists that give it more than 0."""
    return lists.groupBy("topic", "doc_id").agg((F.sum("score") * F.count_if(F.col("score") > 0)).alias("score"))


def position_scores(run: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """1 - rank / length for each document of a list, ranks from 1 in the list's order of score and doc_id."""
    sizes = run.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id"))
    return run.withColumn("rn", rn).join(sizes, keys).withColumn("score", 1 - F.col("rn") / F.col("n")).drop("rn", "n")


def gain_cut(run: DataFrame, cut: float, keys: list[str] = ["topic"]) -> DataFrame:  # noqa: B006
    """The leading documents until their scores exceed ``cut`` of the total; the document that crosses it stays. A total of 0 keeps nothing."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = run.groupBy(*keys).agg(F.sum("score").alias("total"))
    return run.withColumn("before", F.coalesce(F.sum("score").over(order), F.lit(0.0))).join(totals, keys).where((F.col("total") > 0) & (F.col("before") <= cut * F.col("total"))).drop("before", "total")


def coordination_level(matched: DataFrame) -> DataFrame:
    """(topic, doc_id, score): the number of distinct clauses of a topic that match the document; ``matched`` has topic, clause, doc_id."""
    return matched.groupBy("topic", "doc_id").agg(F.count_distinct("clause").cast("double").alias("score"))


def routed_fields(k: Keyword) -> list[str]:
    """Index fields by the keyword's first field."""
    first = k.fields[0] if k.fields else ""
    if set(k.fields) >= {TITLE, ABSTRACT} or first == TEXT:
        return ["ti", "ab"]
    if first in MESH_FIELDS:
        return ["mh"]
    return {TITLE: ["ti"], ABSTRACT: ["ab"], ALL: ["ti", "ab", "mh"]}.get(first, [])


#: The scorers that a keyword's list is fused from.
LEAF_SCORERS = ("bm25", "ln_l2", "title_abstract", "pos", "sum_idf", "pub_date", "doc_len")


def fuse_tree(queries: Mapping[str, Node], collection: sc.Collection, leaf_scorers: tuple[str, ...] = LEAF_SCORERS) -> DataFrame:
    """(topic, doc_id, score): ranked Boolean retrieval by fusion.

    Leaf: the scores of all leaf scorers, each min-max scaled and raised by 1, merged by CombMNZ and
    scaled again. Inner node: the lists of its children merged, by CombSUM for ``and``, else by CombMNZ. All leaves of all
    topics are scored in one plan and written once; inner nodes are merged level by level from the deepest, each level in one aggregation over
    one input: rows that do not rise yet pass through it. The plan grows by one aggregation a level.
    """
    spark = collection.postings.sparkSession
    leaves = {(t, str(k)): k for t, q in queries.items() for k in keywords(q)}
    routed = set()
    for (topic, name), k in leaves.items():
        for f in routed_fields(k):
            words = [k.text.lower()] if f == "mh" else k.text.lower().replace('"', "").split()
            routed |= {(f"{topic}\t{name}", w.rstrip("*"), f) for w in words}
    if not routed:
        return spark.createDataFrame([], "topic string, doc_id long, score double")
    every = written(sc.all_scores(collection, spark.createDataFrame(sorted(routed), "topic string, term string, field string")))
    scaled = _scaled(every, list(leaf_scorers))
    lifted = F.array(*[F.col(n) + 1 for n in leaf_scorers])
    fused = scaled.select("topic", "doc_id", (F.aggregate(lifted, F.lit(0.0), lambda a, v: a + v) * F.size(F.filter(lifted, lambda v: v > 0))).alias("score"))
    leaf = _scaled(fused, ["score"]).select(F.split_part("topic", F.lit("\t"), F.lit(1)).alias("topic"), F.split_part("topic", F.lit("\t"), F.lit(2)).alias("leaf"), "doc_id", (F.col("score") + 1).alias("score"))
    places, inner, deepest = [], [], 0
    for topic, root in queries.items():
        stack = [(root, "0", None, 0)]
        while stack:
            node, place, parent, depth = stack.pop()
            deepest = max(deepest, depth)
            if isinstance(node, Keyword):
                places.append((topic, str(node), place, parent or "", depth))
            else:
                inner.append((topic, place, node.operator == "and", parent or "", depth))
                stack += [(c, f"{place}.{i}", place, depth + 1) for i, c in enumerate(node.children)]
    where = F.broadcast(spark.createDataFrame(places, "topic string, leaf string, place string, parent string, depth int"))
    nodes = F.broadcast(spark.createDataFrame(inner, "topic string, place string, is_and boolean, up string, level int"))
    # By document, so that the merges of all levels need no further shuffle.
    current = leaf.join(where, ["topic", "leaf"]).select("topic", "place", "parent", "depth", "doc_id", "score").repartition("topic", "doc_id")
    for depth in range(deepest, 0, -1):
        rises = F.col("depth") == depth
        target = current.select("topic", F.when(rises, F.col("parent")).otherwise(F.col("place")).alias("place"), "doc_id", "score", rises.alias("rises"), F.when(~rises, F.col("parent")).alias("parent"), F.when(~rises, F.col("depth")).alias("depth"))
        merged = target.groupBy("topic", "place", "doc_id").agg(F.sum("score").alias("s"), F.count_if(F.col("score") > 0).alias("k"), F.max("rises").alias("rises"), F.max("parent").alias("parent"), F.max("depth").alias("depth"))
        placed = merged.join(nodes, ["topic", "place"], "left")
        score = F.when(~F.col("rises") | F.col("is_and"), F.col("s")).otherwise(F.col("s") * F.col("k"))
        current = placed.select("topic", "place", F.coalesce("parent", "up").alias("parent"), F.coalesce("depth", "level").alias("depth"), "doc_id", score.alias("score"))
    return current.where("depth = 0").select("topic", "doc_id", "score")


def _scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] within each topic, 0 where a topic has a single value. The ends are one row for each keyword of the given queries."""
    ends = rows.groupBy("topic").agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))])
    value = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    return rows.join(F.broadcast(ends), "topic").select("topic", "doc_id", *[value(c).alias(c) for c in columns])


def is_boolean(node: Node) -> bool:
    return isinstance(node, Boolean)


def variations(candidates: DataFrame, n_docs: int, seed: int, most: int = 50) -> DataFrame:
    """Candidate queries that retrieve some but not all documents, at most ``most`` per topic in a seeded order: the operator's own limit."""
    order = Window.partitionBy("topic").orderBy(F.xxhash64("query", F.lit(seed)), "query")
    return candidates.where((F.col("retrieved") > 0) & (F.col("retrieved") < n_docs)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
