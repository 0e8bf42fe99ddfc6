"""Sampling of candidate queries (topic, candidate_id, transformation_id, score, ...). Every sampler keeps rows by a fixed order, per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.formulation import split_order

KEY = ["topic"]


def wanted(df: DataFrame, delta: float, n: int, keys: list[str] = KEY) -> DataFrame:
    """``df`` with want = int(delta x candidates of the key) + n."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    return df.join(sizes, keys).withColumn("want", F.floor(F.col("_len") * delta).cast("long") + n)


def _numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "_i") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def balanced(df: DataFrame, delta: float, n: int, keys: list[str] = KEY) -> DataFrame:
    """Transformations in turn: the first candidate of each, then the second, until as many as wanted are taken."""
    turns = _numbered(wanted(df, delta, n, keys), [*keys, "transformation_id"], [F.col("candidate_id")])
    return _numbered(turns, keys, [F.col("_i"), F.col("transformation_id"), F.col("candidate_id")], "_k").where("_k <= want").drop("_i", "_k", "_len", "want")


def stratified(df: DataFrame, delta: float, n: int, keys: list[str] = KEY) -> DataFrame:
    """Of each transformation as many as its share of the wanted number, rounded up."""
    sized = wanted(df, delta, n, keys)
    share = sized.groupBy(*keys, "transformation_id").agg(F.count(F.lit(1)).alias("_m"))
    first = _numbered(sized.join(share, [*keys, "transformation_id"]), [*keys, "transformation_id"], [F.col("candidate_id")])
    return first.where(F.col("_i") <= F.ceil(F.col("want") * F.col("_m") / F.col("_len"))).drop("_i", "_m", "_len", "want")


def random(df: DataFrame, delta: float, n: int, seed: int, keys: list[str] = KEY) -> DataFrame:
    """As many as wanted in a seeded order that other engines can compute too: the same rows however the data is partitioned."""
    return _numbered(wanted(df, delta, n, keys), keys, [split_order("candidate_id", seed), F.col("candidate_id")]).where("_i <= want").drop("_i", "_len", "want")


def balanced_scored(df: DataFrame, n: int, keys: list[str] = KEY) -> DataFrame:
    """Every ceil(len / n)-th of the candidates by falling score."""
    sized = _numbered(wanted(df, 0.0, n, keys), keys, [F.col("score").desc(), F.col("candidate_id")])
    step = F.ceil(F.col("_len") / F.col("want"))
    return sized.where((F.col("_i") - 1) % step == 0).drop("_i", "_len", "want")


def against_baseline(df: DataFrame, baselines: DataFrame, n: int, side: str, keys: list[str] = KEY) -> DataFrame:
    """The first n not below (``positive``) or below (``negative``) the topic's baseline, best first; ``stratified``: each side's share of n, rounded up."""
    flagged = df.join(baselines, keys).withColumn("_up", F.col("score") >= F.col("baseline"))
    if side == "stratified":
        sized = wanted(flagged, 0.0, n, keys)
        share = sized.groupBy(*keys, "_up").agg(F.count(F.lit(1)).alias("_m"))
        first = _numbered(sized.join(share, [*keys, "_up"]), [*keys, "_up"], [F.col("score").desc(), F.col("candidate_id")])
        return first.where(F.col("_i") <= F.ceil(F.col("want") * F.col("_m") / F.col("_len"))).drop("_i", "_m", "_len", "want", "_up", "baseline")
    kept = flagged.where(F.col("_up") if side == "positive" else ~F.col("_up"))
    return _numbered(kept, keys, [F.col("score").desc(), F.col("candidate_id")]).where(F.col("_i") <= n).drop("_i", "_up", "baseline")


def greedy(df: DataFrame, n: int, retrieved: str = "retrieved", keys: list[str] = KEY) -> DataFrame:
    """The n candidates that retrieve least, of equal ones the best."""
    return _numbered(df, keys, [F.col(retrieved), F.col("score").desc(), F.col("candidate_id")]).where(F.col("_i") <= n).drop("_i")


def maximal_marginal_relevance(df: DataFrame, n: int, weight: float = 0.5, keys: list[str] = KEY) -> DataFrame:
    """(keys, candidate_id, score, pick): greedy choice of weight x score - (1 - weight) x largest cosine to those picked.

    A topic's candidates are the variations of one query and are chosen in one task; only ids, scores and features travel.
    """
    import numpy as np

    schema = df.select(*keys, "candidate_id", "score").schema.simpleString()[7:-1] + ", pick int"

    def pick(pdf):
        pdf = pdf.sort_values("candidate_id", ignore_index=True)
        ids = sorted({f for m in pdf["features"] for f in dict(m or {})})
        at = {f: i for i, f in enumerate(ids)}
        x = np.zeros((len(pdf), max(1, len(ids))))
        for r, m in enumerate(pdf["features"]):
            for f, v in dict(m or {}).items():
                x[r, at[f]] = v
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        score, near = pdf["score"].to_numpy(float), np.zeros(len(pdf))
        left, order = np.ones(len(pdf), bool), []
        while left.any() and len(order) < n:
            value = np.where(left, weight * score - (1 - weight) * near, -np.inf)
            best = int(value.argmax())
            order.append(best)
            left[best] = False
            near = np.maximum(near, x @ x[best])
        return pdf.iloc[order][[*keys, "candidate_id", "score"]].assign(pick=np.arange(1, len(order) + 1, dtype="int32"))

    return df.select(*keys, "candidate_id", "score", "features").groupBy(*keys).applyInPandas(pick, schema)


def clustered(df: DataFrame, n: int, k: int = 3, seed: int = 1, keys: list[str] = KEY, size: int = 64) -> DataFrame:
    """n candidates taken from k-means clusters of the feature vectors in turn, best score first in each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("features", i), F.lit(0.0)))
    x = df.withColumn("_x", array_to_vector(dense))
    model = KMeans(featuresCol="_x", predictionCol="cluster", k=k if k > 0 else 3, maxIter=10, seed=seed).fit(x)
    turns = _numbered(model.transform(x), [*keys, "cluster"], [F.col("score").desc(), F.col("candidate_id")])
    return _numbered(turns, keys, [F.col("_i"), F.col("cluster"), F.col("candidate_id")], "_k").where(F.col("_k") <= n).drop("_i", "_k", "_x")
