"""Selecting and exploring candidate queries: oracles, nearest neighbours, learnt rankers and explorers."""

from __future__ import annotations

import random as rnd
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators.formulation import split_order
from ferrule.plans.boolean import matching
from ferrule.plans.variations import Candidate, variations
from ferrule.tables import written


def best_of(df: DataFrame, keys: list[str] = ["topic"]) -> DataFrame:  # noqa: B006
    """The candidate with the largest score of each topic; of equal ones the smallest id."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "candidate_id"))).where("_i = 1").drop("_i")


def oracle(df: DataFrame, current: DataFrame) -> DataFrame:
    """Per topic a candidate with no fewer relevant results and no more results than the current query: most relevant, then fewest results.

    ``df`` has rel_ret and ret, ``current`` (topic, cur_rel_ret, cur_ret).
    """
    fit = df.join(current, "topic").where("rel_ret >= cur_rel_ret AND ret <= cur_ret")
    order = Window.partitionBy("topic").orderBy(F.col("rel_ret").desc(), "ret", "candidate_id")
    return fit.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i", "cur_rel_ret", "cur_ret")


def executed(candidates: Mapping[str, list[Candidate]], postings: DataFrame, judged: DataFrame) -> DataFrame:
    """(topic, candidate_id, transformation_id, ret, rel_ret, rel): what every candidate query of every topic retrieves, and how much of it is relevant.

    ``candidate_id`` is the position in the topic's list, ``judged`` (topic, doc_id) the relevant documents, ``rel`` their number. All queries are
    executed by one scan of the postings they want and one aggregation by document; a query without results has zeros.
    """
    spark = postings.sparkSession
    named = {f"{topic}\t{i}": c for topic, cs in candidates.items() for i, c in enumerate(cs)}
    known = spark.createDataFrame([(*n.rsplit("\t", 1), c.transformation) for n, c in named.items()], "topic string, candidate_id string, transformation_id int")
    hits = matching({n: c.query for n, c in named.items()}, postings).select(*[F.split_part("topic", F.lit("\t"), F.lit(i)).alias(n) for i, n in ((1, "topic"), (2, "candidate_id"))], "doc_id")
    relevant = judged.select("topic", "doc_id").distinct()
    sums = hits.join(relevant.withColumn("r", F.lit(1)), ["topic", "doc_id"], "left").groupBy("topic", "candidate_id").agg(F.count(F.lit(1)).alias("ret"), F.count("r").alias("rel_ret"))
    rel = relevant.groupBy("topic").agg(F.count(F.lit(1)).alias("rel"))
    out = known.join(sums, ["topic", "candidate_id"], "left").join(rel, "topic", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("topic", F.col("candidate_id").cast("long").alias("candidate_id"), "transformation_id", zero("ret"), zero("rel_ret"), zero("rel"))


def f1_scored(df: DataFrame) -> DataFrame:
    """``executed`` with score, the F1 of each candidate; 0 where it finds nothing relevant."""
    return df.withColumn("score", F.when(F.col("rel_ret") > 0, 2 * F.col("rel_ret") / (F.col("ret") + F.col("rel"))).otherwise(0.0))


def random_choice(df: DataFrame, seed: int) -> DataFrame:
    order = Window.partitionBy("topic").orderBy(split_order("candidate_id", seed), "candidate_id")
    return df.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def average_scores(df: DataFrame) -> DataFrame:
    """``df`` with average_score, the mean of the scores that are there; null without any."""
    usable = F.filter("scores", lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(usable, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("average_score", F.when(F.size(usable) > 0, total / F.size(usable)))


def _long(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode("features").alias("f", "v")).where("v IS NOT NULL AND v <> 0")


def train_nearest(df: DataFrame) -> DataFrame:
    """(model_topic, best_features, max_score): the features of each topic's best candidate."""
    return best_of(df).select(F.col("topic").alias("model_topic"), F.col("features").alias("best_features"), F.col("score").alias("max_score"))


def cosines(df: DataFrame, model: DataFrame) -> DataFrame:
    """(topic, candidate_id, model_topic, cosine) of candidates and model vectors that share a feature, from a join on features; others have cosine 0."""
    a = _long(df, ["topic", "candidate_id"])
    b = _long(model.withColumnRenamed("best_features", "features"), ["model_topic"]).withColumnRenamed("v", "w")
    na = a.groupBy("topic", "candidate_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("na"))
    nb = b.groupBy("model_topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    dots = a.join(b, "f").groupBy("topic", "candidate_id", "model_topic").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return dots.join(na, ["topic", "candidate_id"]).join(nb, "model_topic").select("topic", "candidate_id", "model_topic", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


#: Feature entries of the model vectors that are compared in one pass: what a broadcast holds.
PASS_ENTRIES = 500_000
#: Shares of a squared norm are told apart down to 2 ** -LEAST_SHARE.
LEAST_SHARE = 12
#: More than the rounding errors of a bound.
SLACK = 1e-7


def _share_class(share: Column) -> Column:
    """How often a share of a squared norm can be doubled before it passes 1, as a whole number up to LEAST_SHARE."""
    return F.when((share > 0) & (share < 2), F.greatest(F.lit(0), F.least(F.lit(LEAST_SHARE), F.floor(-F.log2(share))))).otherwise(LEAST_SHARE).cast("int")


def _used(features: str) -> Column:
    return F.map_filter(features, lambda f, x: x.isNotNull() & (x != 0))


def _unit(df: DataFrame) -> DataFrame:
    """``df`` (v: a map without zeros) with its norm n and e, the entries (m, f, u) of its unit vector, largest first; u is NaN where squares leave the range of a double."""
    n = F.sqrt(F.aggregate(F.map_values("v"), F.lit(0.0), lambda s, x: s + x * x))
    inside = (F.col("n") > 1e-150) & (F.col("n") < 1e150)
    entry = lambda x: F.struct(F.abs(x["value"]).alias("m"), x["key"].alias("f"), F.when(inside, x["value"] / F.col("n")).otherwise(float("nan")).alias("u"))
    return df.where(F.size("v") > 0).withColumn("n", n).withColumn("e", F.sort_array(F.transform(F.map_entries("v"), entry), asc=False))


def _key(kind: int, f: Column, g: Column, x: Column, y: Column, *rest: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), f.alias("f"), g.cast("int").alias("g"), x.alias("x"), y.alias("y"), *[r.alias("rest") for r in rest])


def _pair_key(p: Column, q: Column, *rest: Column) -> Column:
    u = lambda a, b: F.when(p["f"] < q["f"], a).otherwise(b)
    return _key(2, F.least(p["f"], q["f"]), F.greatest(p["f"], q["f"]), u(p["u"], q["u"]), u(q["u"], p["u"]), *rest)


def _posts(models: DataFrame) -> DataFrame:
    """(kind, f, g, wx, wy, rest, m): where a vector finds the models, by the features that the two share.

    kind 2: the model's two largest features; 1: its largest only, with the class of the share of the second; 0: not its largest but another,
    with the class of the share of the largest. rest: what of the model's squared norm is not yet known to meet something or nothing.
    """
    first, second = F.get("e", F.lit(0)), F.get("e", F.lit(1))  # a filter may be evaluated before empty vectors are gone
    square = lambda c: c["u"] * c["u"]
    one, two = square(first), F.coalesce(square(second), F.lit(0.0))
    both = F.when(F.size("e") > 1, F.array(_pair_key(first, second, 1 - one - two))).otherwise(F.array())
    largest = F.array(_key(1, first["f"], _share_class(two), first["u"], F.lit(0.0), 1 - one - two))
    others = F.transform(F.slice("e", 2, F.greatest(F.size("e"), F.lit(1))), lambda c: _key(0, c["f"], _share_class(one), c["u"], F.lit(0.0), 1 - one - square(c)))
    return models.select("m", F.explode(F.concat(both, largest, others)).alias("k")).select("k.kind", "k.f", "k.g", F.col("k.x").alias("wx"), F.col("k.y").alias("wy"), "k.rest", "m")


def _cosine_pairs(probes: DataFrame, posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(topic, candidate_id, m, cosine) of probes (a key of a candidate a row, with floor, the least cosine of interest) and models of other topics.

    By Cauchy's inequality a cosine is at most that of the known shared features plus the product of what is left of both norms. Only the few
    pairs whose bound reaches the floor are computed; none is stored or shuffled before that.
    """
    bound = F.col("x") * F.col("wx") + F.col("y") * F.col("wy") + F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("x") * F.col("x") - F.col("y") * F.col("y")) * F.greatest(F.lit(0.0), F.col("rest")))
    near = probes.join(F.broadcast(posts), ["kind", "f", "g"]).where(bound + SLACK >= F.col("floor")).drop("kind", "f", "g", "x", "y", "wx", "wy", "rest")
    dot = F.aggregate(F.map_entries("v"), F.lit(0.0), lambda s, x: s + F.coalesce(x["value"] * F.try_element_at("w", x["key"]), F.lit(0.0)))
    pairs = near.join(F.broadcast(vectors.select("m", "model_topic", F.col("v").alias("w"), F.col("n").alias("nw"))), "m").where("topic <> model_topic")
    return pairs.withColumn("cosine", dot / (F.col("n") * F.col("nw"))).where(F.col("cosine") + SLACK >= F.col("floor")).select("topic", "candidate_id", "m", "cosine")


def _first_floor(units: DataFrame, posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(topic, floor): the largest cosine of a topic's candidates and the models that have the same two largest features."""
    e, first = F.col("e"), F.get("e", F.lit(0))
    own = F.when(F.size(e) > 1, _pair_key(first, F.get(e, F.lit(1)))).otherwise(_key(1, first["f"], F.lit(LEAST_SHARE), first["u"], F.lit(0.0)))
    probes = units.select("topic", "candidate_id", "v", "n", F.lit(-2.0).alias("floor"), own.alias("k")).select("topic", "candidate_id", "v", "n", "floor", "k.*")
    pairs = _cosine_pairs(probes, posts, vectors)
    return pairs.groupBy("topic").agg(F.max("cosine").alias("floor"))


def _probes(units: DataFrame, floors: DataFrame) -> DataFrame:
    """The keys of all models that may reach the floor of each of ``units``, a row each.

    For a cosine t the shared features have at least the share t * t of either squared norm. So a feature of a larger share than 1 - t * t is
    shared: the two largest of a model (kind 2), unless the second (kind 1) or the first (kind 0) has at most that share.
    """
    t = F.col("floor") - SLACK
    least = F.when((t > 0) & ~F.isnan(t) & ~F.isnan(F.get("e", F.lit(0))["u"]), _share_class(1 - t * t)).otherwise(0)
    second = lambda kind, g, y: F.struct(F.lit(kind).alias("kind"), g.alias("g"), y.alias("y"))
    others = F.transform("e", lambda q: second(2, q["f"], q["u"]))
    classes = [F.transform(F.sequence(least, F.lit(LEAST_SHARE)), lambda g: second(kind, g, F.lit(0.0))) for kind in (1, 0)]
    known = units.join(floors, "topic", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    kept = ["topic", "candidate_id", "v", "n", "floor"]
    keys = known.select(*kept, "e", F.concat(others, *classes).alias("s")).select(*kept, "s", F.explode("e").alias("p")).select(*kept, "p", F.explode("s").alias("q"))
    return keys.where("q.kind < 2 OR p.f < q.g").select(*kept, "q.kind", "p.f", "q.g", F.col("p.u").alias("x"), "q.y")


def nearest_selector(df: DataFrame, model: DataFrame) -> DataFrame:
    """(topic, candidate_id, model_topic, cosine): per topic the candidate nearest to the best vector of another topic, of ``cosines``.

    Exact, without all pairs of candidates and models: see ``_probes`` and ``_cosine_pairs``. Models are taken in passes of PASS_ENTRIES, so the
    candidates are read once or twice a pass; what leaves a task is a row for each candidate that is still in question.
    """
    units = _unit(written(df.where("topic IS NOT NULL AND candidate_id IS NOT NULL").select("topic", "candidate_id", _used("features").alias("v"))))
    models = written(model.where("model_topic IS NOT NULL").select("model_topic", _used("best_features").alias("v")))
    passes = max(1, -(-(models.agg(F.sum(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0) // PASS_ENTRIES))
    within = F.row_number().over(Window.partitionBy("pass").orderBy("model_topic"))
    models = _unit(written(models.repartitionByRange(passes, "model_topic").withColumn("pass", F.spark_partition_id()).withColumn("m", within)))
    order = Window.partitionBy("topic").orderBy(F.round("cosine", 9).desc(), "candidate_id", "model_topic")
    first = lambda d: d.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")
    # a cosine in steps of 1e-9 and, of equal ones, the first model, as one number; NaN comes first, as in the order
    last, nan = 2**31 - 1, 2**31 - 1
    steps = F.when(F.isnan("cosine"), F.lit(nan).cast("long")).otherwise(F.round((F.least(F.greatest(F.round("cosine", 9), F.lit(-1.0)), F.lit(1.0)) + 1) * 1e9).cast("long"))
    best = None
    for k in range(passes):
        vectors = models.where(F.col("pass") == k)
        posts = _posts(vectors)
        floors = best.groupBy("topic").agg(F.max("cosine").alias("floor")) if best is not None else _first_floor(units, posts, vectors)
        pairs = _cosine_pairs(_probes(units, floors), posts, vectors).withColumn("rank", F.shiftleft(steps, 31) + (last - F.col("m")))
        found = pairs.groupBy("topic", "candidate_id").agg(F.max("rank").alias("rank"), F.max_by("cosine", "rank").alias("cosine"))
        found = found.withColumn("m", last - F.col("rank").bitwiseAND(F.lit(last).cast("long"))).join(F.broadcast(vectors.select("m", "model_topic")), "m")
        found = written(first(found.select("topic", "candidate_id", "model_topic", "cosine")))
        best = found if best is None else best.unionByName(found)
    return first(best)


def dense_features(df: DataFrame, size: int = 64) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("features", i), F.lit(0.0)))
    return df.withColumn("x", array_to_vector(dense))


def train_ranker(df: DataFrame, kind: str = "linear", seed: int = 1):
    """A model of the score within its topic from features: ``linear`` regression, or gradient-boosted ``trees``. All rows are read."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    mean = df.groupBy("topic").agg(F.avg("score").alias("_m"))
    centred = dense_features(df).join(mean, "topic").withColumn("y", F.col("score") - F.col("_m"))
    if kind == "trees":
        return GBTRegressor(featuresCol="x", labelCol="y", predictionCol="predicted", maxIter=10, maxDepth=3, seed=seed).fit(centred)
    return LinearRegression(featuresCol="x", labelCol="y", predictionCol="predicted", regParam=0.1).fit(centred)


def select_by(model, df: DataFrame) -> DataFrame:
    """(topic, candidate_id, predicted): the candidate of each topic that the model puts first."""
    scored = model.transform(dense_features(df)).select("topic", "candidate_id", F.col("predicted").alias("score"))
    return best_of(scored).withColumnRenamed("score", "predicted")


# Explorers walk the variations of one query on the driver; what they score is a callable, usually a Spark plan.

Sampler = Callable[[list[Candidate]], list[Candidate]]


def breadth_first(start: Candidate, sample: Sampler, max_depth: int = 3) -> list[Candidate]:
    """All sampled candidates, level by level; a query reached twice is kept once."""
    seen, level, out = {str(start.query)}, [start], []
    for _ in range(max_depth):
        grown = []
        for c in level:
            for v in variations(c):
                if str(v.query) not in seen:
                    seen.add(str(v.query))
                    grown.append(v)
        level = sample(grown)
        out += level
        if not level:
            break
    return out


Criterion = Callable[[Candidate, list[Candidate], rnd.Random], bool]


def probabilistic(p: float) -> Criterion:
    return lambda c, taken, r: r.random() < p


def balanced_transformations() -> Criterion:
    """Only candidates of a transformation that is not ahead of the rarest taken so far."""

    def keep(c: Candidate, taken: list[Candidate], r: rnd.Random) -> bool:
        counts: dict[int, int] = {}
        for t in taken:
            counts[t.transformation] = counts.get(t.transformation, 0) + 1
        return counts.get(c.transformation, 0) <= min(counts.values(), default=0)

    return keep


def biased_transformations(weights: dict[int, float]) -> Criterion:
    return lambda c, taken, r: r.random() < weights.get(c.transformation, 0.0)


def evaluated(score: Callable[[Candidate], float], baseline: float, positive: bool = True) -> Criterion:
    return lambda c, taken, r: (score(c) >= baseline) == positive


def depth_first(start: Candidate, keep: Criterion, budget: int, max_chain: int = 5, seed: int = 1) -> list[Candidate]:
    """At most ``budget`` candidates that ``keep`` accepts, going down from each accepted one while its chain is shorter than ``max_chain``."""
    r, seen, out, stack = rnd.Random(seed), {str(start.query)}, [], [start]
    while stack and len(out) < budget:
        at = stack.pop()
        if len(at.chain) >= max_chain:
            continue
        options = variations(at)
        r.shuffle(options)
        for v in options:
            if len(out) >= budget:
                break
            if str(v.query) not in seen and keep(v, out, r):
                seen.add(str(v.query))
                out.append(v)
                stack.append(v)
    return out


def run_chain(start: Candidate, select: Callable[[Candidate, list[Candidate]], Candidate | None], max_depth: int = 5) -> list[Candidate]:
    """The chain of selected candidates; ends at the depth, without a candidate, or when the selection does not change the query."""
    chain = [start]
    while len(chain) <= max_depth:
        options = variations(chain[-1])
        nxt = select(chain[-1], options) if options else None
        if nxt is None or str(nxt.query) == str(chain[-1].query):
            break
        chain.append(nxt)
    return chain


def generate(starts: Mapping[str, Candidate], postings: DataFrame, judged: DataFrame, depth: int = 1, sample: Sampler = lambda level: level) -> DataFrame:
    """(topic, candidate_id, transformation_id, ret, rel_ret, rel, score, depth, query, features): the sampled candidates of every topic, all executed in one plan."""
    made = {topic: breadth_first(c, sample, depth) for topic, c in starts.items()}
    rows = [(topic, i, c.depth, str(c.query), dict(c.features)) for topic, cs in made.items() for i, c in enumerate(cs)]
    known = postings.sparkSession.createDataFrame(rows, "topic string, candidate_id long, depth int, query string, features map<int,double>")
    return f1_scored(executed(made, postings, judged)).join(known, ["topic", "candidate_id"])


def validate(model, generated: DataFrame) -> DataFrame:
    """(topic, candidate_id, score, best): the score of the candidate that the model puts first in each topic, and that of the topic's best."""
    chosen = select_by(model, generated).select("topic", "candidate_id")
    best = generated.groupBy("topic").agg(F.max("score").alias("best"))
    return generated.select("topic", "candidate_id", "score").join(chosen, ["topic", "candidate_id"], "left_semi").join(best, "topic")


def model_choice(spark: SparkSession, model) -> Callable[[Candidate, list[Candidate]], Candidate | None]:
    """For ``run_chain``: the option that the model puts first, by its features alone."""

    def select(current: Candidate, options: list[Candidate]) -> Candidate | None:
        rows = spark.createDataFrame([("t", i, dict(c.features)) for i, c in enumerate(options)], "topic string, candidate_id long, features map<int,double>")
        return options[select_by(model, rows).first().candidate_id]

    return select


def candidate_rows(candidates: Iterable[Candidate], topic: str) -> list[tuple]:
    """Rows (topic, candidate_id, transformation_id, depth, query, chain, features) of explored candidates."""
    from ferrule.plans.ast import to_json

    return [(topic, i, c.transformation, c.depth, to_json(c.query), list(c.chain), dict(c.features)) for i, c in enumerate(candidates)]


CANDIDATE_SCHEMA = "topic string, candidate_id long, transformation_id int, depth int, query string, chain array<int>, features map<int,double>"
