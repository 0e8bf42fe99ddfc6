"""Evaluation of runs against relevance judgements, all topics and runs in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["topic", "run_name"]


def ranked(run: DataFrame) -> DataFrame:
    """(topic, run_name, doc_id, score, rn): each document of a run once, with its best score, in order of falling score and rising id from 1.

    doc_id is compared as a number; rows with null topic or document, or null or NaN score, do not count.
    """
    rows = run.select("topic", "run_name", F.expr("try_cast(trim(CAST(doc_id AS STRING)) AS bigint)").alias("doc_id"), "score").where("topic IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy(*KEYS, "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rn", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), "doc_id")).cast("long"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A ranked run with the grade of each document, null where it is not judged."""
    return run.join(qrels.select("topic", "doc_id", "grade"), ["topic", "doc_id"], "left")


def counts(run: DataFrame, qrels: DataFrame, grade: int = 0) -> DataFrame:
    """(topic, run_name, num_ret, num_rel, num_rel_ret, num_nonrel): relevant is a grade above ``grade``."""
    per_run = judged(run, qrels).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_ret"), F.count_if(F.col("grade") > grade).alias("num_rel_ret"))
    per_topic = qrels.groupBy("topic").agg(F.count_if(F.col("grade") > grade).alias("num_rel"), F.count_if(F.col("grade") <= grade).alias("num_nonrel"))
    return per_run.join(per_topic, "topic", "left").na.fill(0, ["num_rel", "num_nonrel"])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall(c: DataFrame, compat: bool = False) -> DataFrame:
    """Adds precision and recall. ``compat``: precision is 0 when nothing retrieved is not relevant, as in the classic tool."""
    precision = ratio(F.col("num_rel_ret"), F.col("num_ret"))
    if compat:
        precision = F.when(F.col("num_rel_ret") == F.col("num_ret"), 0.0).otherwise(precision)
    return c.withColumn("precision", precision).withColumn("recall", ratio(F.col("num_rel_ret"), F.col("num_rel")))


def f_measure(beta: float, precision: Column | None = None, recall: Column | None = None) -> Column:
    p, r, b = F.col("precision") if precision is None else precision, F.col("recall") if recall is None else recall, beta * beta
    return F.when((p > 0) & (r > 0), (1 + b) * p * r / (b * p + r)).otherwise(0.0)


def wss(collection_size: int | Column, recall: Column | None = None) -> Column:
    n = F.lit(collection_size) if isinstance(collection_size, int) else collection_size
    return F.when(n > 0, (n - F.col("num_ret")) / n).otherwise(0.0) - (1 - (F.col("recall") if recall is None else recall))


def nnr() -> Column:
    return (F.col("num_ret") + 1) / (F.col("num_rel_ret") + 1)


def at_k(run: DataFrame, qrels: DataFrame, ks: list[int], grade: int = 0) -> DataFrame:
    """(topic, run_name, p_k..., recall_k...): p = relevant among the first K over K, recall over all relevant."""
    j = judged(run, qrels).groupBy(*KEYS).agg(*[F.count_if((F.col("rn") <= k) & (F.col("grade") > grade)).alias(f"h{k}") for k in ks])
    rel = qrels.groupBy("topic").agg(F.count_if(F.col("grade") > grade).alias("num_rel"))
    out = j.join(rel, "topic", "left")
    return out.select(*KEYS, *[(F.col(f"h{k}") / k).alias(f"p_{k}") for k in ks], *[ratio(F.col(f"h{k}"), F.coalesce("num_rel", F.lit(0))).alias(f"recall_{k}") for k in ks])


def average_precision(run: DataFrame, qrels: DataFrame, grade: int = 0) -> DataFrame:
    """(topic, run_name, ap): sum of precision at the relevant documents over the number of relevant ones; 0 without any.

    Only relevant rows are numbered: the precision at a relevant document is its number among them over its rank.
    """
    rel = qrels.where(F.col("grade") > grade)
    hits = run.join(rel.select("topic", "doc_id"), ["topic", "doc_id"]).withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("rn")))
    total = rel.groupBy("topic").agg(F.count(F.lit(1)).alias("num_rel"))
    sums = hits.groupBy(*KEYS).agg(F.sum(F.col("k") / F.col("rn")).alias("s"))
    return run.select(*KEYS).distinct().join(sums, KEYS, "left").join(total, "topic", "left").select(*KEYS, F.coalesce(F.col("s") / F.col("num_rel"), F.lit(0.0)).alias("ap"))


def dcg(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(topic, run_name, dcg_k..., ndcg_k...): linear gain; K = 0 takes the whole list; nDCG is 0 where the ideal is 0."""
    gain = lambda g, rn, k: F.sum(F.when((rn <= k) if k else F.lit(True), F.coalesce(g, F.lit(0)) / F.log2(rn + 1)).otherwise(0.0))
    got = judged(run, qrels).groupBy(*KEYS).agg(*[gain(F.col("grade"), F.col("rn"), k).alias(f"dcg_{k}") for k in ks])
    best = qrels.withColumn("i", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("grade").desc(), "doc_id")))
    ideal = best.groupBy("topic").agg(*[gain(F.col("grade"), F.col("i"), k).alias(f"i{k}") for k in ks])
    out = got.join(ideal, "topic", "left")
    return out.select(*KEYS, *[f"dcg_{k}" for k in ks], *[F.when(F.col(f"i{k}") > 0, F.col(f"dcg_{k}") / F.col(f"i{k}")).otherwise(0.0).alias(f"ndcg_{k}") for k in ks])


def residual_counts(run: DataFrame, qrels: DataFrame, grade: int = 0) -> DataFrame:
    """``counts`` with every retrieved document that is not judged taken as relevant."""
    c = judged(run, qrels).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_ret"), F.count_if(F.coalesce(F.col("grade") > grade, F.lit(True))).alias("num_rel_ret"), F.count_if(F.col("grade").isNull()).alias("unjudged"))
    per_topic = qrels.groupBy("topic").agg(F.count_if(F.col("grade") > grade).alias("r"))
    return c.join(per_topic, "topic", "left").select(*KEYS, "num_ret", "num_rel_ret", (F.coalesce("r", F.lit(0)) + F.col("unjudged")).alias("num_rel"))


def mle_counts(run: DataFrame, qrels: DataFrame, grade: int = 0) -> DataFrame:
    """``counts`` with the first floor((relevant + 1) / (not relevant + 1)) documents that are not judged taken as relevant, in run order."""
    per_topic = qrels.groupBy("topic").agg(F.count_if(F.col("grade") > grade).alias("r"), F.count_if(F.col("grade") <= grade).alias("nr"))
    taken = F.floor((F.coalesce("r", F.lit(0)) + 1) / (F.coalesce("nr", F.lit(0)) + 1))
    j = judged(run, qrels)
    c = j.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_ret"), F.count_if(F.col("grade") > grade).alias("hit"), F.count_if(F.col("grade").isNull()).alias("unjudged"))
    more = F.least(F.col("unjudged"), taken)
    return c.join(per_topic, "topic", "left").select(*KEYS, "num_ret", (F.col("hit") + more).alias("num_rel_ret"), (F.coalesce("r", F.lit(0)) + more).alias("num_rel"))


def deduplicate_titles(run: DataFrame, docs: DataFrame, title: str = "ti") -> DataFrame:
    """The run without documents whose title an earlier document of the same topic and run has; documents without a title stay.

    The first of each title is found by an aggregation, combined before the shuffle; documents without a title take no part in it.
    """
    held = run.join(docs.select("doc_id", F.lower(F.trim(title)).alias("_t")), "doc_id", "left")
    named = F.coalesce(F.col("_t"), F.lit("")) != ""
    first = held.where(named).groupBy(*KEYS, "_t").agg(F.min(F.struct("rn", *[c for c in run.columns if c not in (*KEYS, "rn")])).alias("_r"))
    kept = first.select(*[c if c in KEYS else F.col(f"_r.{c}").alias(c) for c in run.columns])
    return kept.unionByName(held.where(~named).select(*run.columns))


#: Which documents count as relevant: the judged ones; with all retrieved that are not judged; with the likely number of these.
VARIANTS = ("", "_res", "_mle")


def judged_once(run: DataFrame, qrels: DataFrame, ks: list[int], gain_ks: list[int], grade: int = 0) -> DataFrame:
    """One row per (topic, run_name) with the counts that every measure of every variant needs, from one pass over the judged run.

    The residual variant takes every retrieved document that is not judged as relevant, the maximum-likelihood variant the first
    floor((relevant + 1) / (not relevant + 1)) of them in run order, both with grade ``grade`` + 1. Per variant v: num_rel_ret v, num_rel v, hits@K v for
    ``ks``, precisions v (the sum of precision at the relevant documents), dcg@K v for ``gain_ks``; besides num_ret, num_nonrel, the topic's ``grades``
    (grade, number) and ``added`` v, the documents taken as relevant. K = 0 is the whole list.
    """
    counted = qrels.groupBy("topic", "grade").agg(F.count(F.lit(1)).alias("n"))
    topics = counted.groupBy("topic").agg(
        F.sum(F.when(F.col("grade") > grade, F.col("n")).otherwise(0)).alias("rel"), F.sum(F.when(F.col("grade") > grade, 0).otherwise(F.col("n"))).alias("nonrel"),
        F.sort_array(F.collect_list(F.struct("grade", "n")), asc=False).alias("grades"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = topics.select("topic", F.floor((F.col("rel") + 1) / (F.col("nonrel") + 1)).alias("likely"))
    j = judged(run, qrels).join(known, "topic", "left").withColumn("likely", F.coalesce("likely", F.lit(1)))
    so_far = Window.partitionBy(*KEYS).orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_rel, unjudged = F.coalesce(F.col("grade") > grade, F.lit(False)), F.col("grade").isNull()
    j = j.withColumns({"rel": is_rel, "un": unjudged}).withColumns({"hits": F.count_if("rel").over(so_far), "uns": F.count_if("un").over(so_far)})
    rel = {"": F.col("rel"), "_res": F.col("rel") | F.col("un"), "_mle": F.col("rel") | (F.col("un") & (F.col("uns") <= F.col("likely")))}
    hits = {"": F.col("hits"), "_res": F.col("hits") + F.col("uns"), "_mle": F.col("hits") + F.least("uns", "likely")}
    within = lambda k: (F.col("rn") <= k) if k else F.lit(True)
    sums = [F.count(F.lit(1)).alias("num_ret")]
    for v in VARIANTS:
        gain = F.when(rel[v] & F.col("un"), grade + 1).otherwise(zero(F.col("grade"))) / F.log2(F.col("rn") + 1)
        sums += [F.count_if(rel[v]).alias(f"num_rel_ret{v}"), F.count_if(rel[v] & F.col("un")).alias(f"added{v}"), F.sum(F.when(rel[v], hits[v] / F.col("rn")).otherwise(0.0)).alias(f"precisions{v}")]
        sums += [F.count_if(within(k) & rel[v]).alias(f"hits@{k}{v}") for k in ks] + [F.sum(F.when(within(k), gain).otherwise(0.0)).alias(f"dcg@{k}{v}") for k in gain_ks]
    out = j.groupBy(*KEYS).agg(*sums).join(topics, "topic", "left").withColumns({"rel": zero(F.col("rel")), "num_nonrel": zero(F.col("nonrel"))})
    return out.withColumns({f"num_rel{v}": F.col("rel") + F.col(f"added{v}") for v in VARIANTS}).drop("rel", "nonrel")


def ideal_gain(grades: Column, added: Column, k: int, grade: int = 0) -> Column:
    """The DCG at k (0: of all) of the topic's grades in falling order with ``added`` documents of grade ``grade`` + 1 among them."""
    more = F.sort_array(F.concat(F.coalesce(grades, F.array().cast("array<struct<grade:bigint,n:bigint>>")).cast("array<struct<grade:bigint,n:bigint>>"), F.array(F.struct(F.lit(grade + 1).cast("long").alias("grade"), added.cast("long").alias("n")))), asc=False)
    total = F.aggregate(more, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    last = F.least(total, F.lit(k)) if k else total
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("sum"))

    def add(a: Column, x: Column) -> Column:
        places = F.sequence(a["at"] + 1, F.least(a["at"] + x["n"], last))
        discounts = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        return F.struct((a["at"] + x["n"]).alias("at"), (a["sum"] + F.when((x["n"] > 0) & (a["at"] < last) & (x["grade"] != 0), x["grade"] * discounts).otherwise(0.0)).alias("sum"))

    return F.aggregate(more, start, add)["sum"]


@dataclass(frozen=True)
class Measure:
    """A value of one row of ``judged_once``, and the cut-offs it needs there."""

    value: Callable[[], Column]
    ks: tuple[int, ...] = ()
    gain_ks: tuple[int, ...] = ()


def registry(collection_size: int, grade: int = 0) -> dict[str, Measure]:
    """The named measures of the evaluation command. Every measure but the plain counts also as ``_res`` and ``_mle``."""
    out: dict[str, Measure] = {name: Measure(lambda name=name: F.col(name)) for name in ("num_ret", "num_rel", "num_rel_ret")}
    for v in VARIANTS:
        found, rel, n = (lambda v=v: F.col(f"num_rel_ret{v}")), (lambda v=v: F.col(f"num_rel{v}")), (lambda: F.col("num_ret"))
        p, r = (lambda found=found, n=n: ratio(found(), n())), (lambda found=found, rel=rel: ratio(found(), rel()))
        out[f"precision{v}"], out[f"recall{v}"] = Measure(p), Measure(r)
        for b in (0.5, 1.0, 3.0):
            out[f"f{b:g}{v}"] = Measure(lambda b=b, p=p, r=r: f_measure(b, p(), r()))
        out[f"wss{v}"] = Measure(lambda r=r: wss(collection_size, r()))
        out[f"nnr{v}"] = Measure(lambda found=found: (F.col("num_ret") + 1) / (found() + 1))
        out[f"ap{v}"] = Measure(lambda v=v, rel=rel: ratio(F.col(f"precisions{v}"), rel()))
        for k in (10, 100, 1000):
            out[f"p@{k}{v}"] = Measure(lambda k=k, v=v: F.col(f"hits@{k}{v}") / k, (k,))
            out[f"recall@{k}{v}"] = Measure(lambda k=k, v=v, rel=rel: ratio(F.col(f"hits@{k}{v}"), rel()), (k,))
        for k in (5, 10, 100, 200, 500):
            out[f"ndcg@{k}{v}"] = Measure(lambda k=k, v=v: ratio(F.col(f"dcg@{k}{v}"), ideal_gain(F.col("grades"), F.col(f"added{v}"), k, grade)), (), (k,))
    return out


def evaluate(run: DataFrame, qrels: DataFrame, measures: dict[str, Measure], grade: int = 0) -> DataFrame:
    """(topic, run_name, name, value) of all given measures: one pass over the judged run, however many they are."""
    ks, gain_ks = sorted({k for m in measures.values() for k in m.ks}), sorted({k for m in measures.values() for k in m.gain_ks})
    wide = judged_once(run, qrels, ks, gain_ks, grade)
    values = F.array(*[F.struct(F.lit(name).alias("name"), m.value().cast("double").alias("value")) for name, m in measures.items()])
    return wide.select(*KEYS, F.inline(values))


def summary(evaluated: DataFrame) -> DataFrame:
    """(run_name, name, mean, topics)."""
    return evaluated.groupBy("run_name", "name").agg(F.avg("value").alias("mean"), F.count_distinct("topic").alias("topics"))
