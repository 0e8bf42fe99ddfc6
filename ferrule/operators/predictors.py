"""Query performance predictors before and after retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.scorers import Collection
from ferrule.operators.statistics import idf, jelinek_mercer, kl_divergence, language_model


def _guarded_log(c: Column) -> Column:
    return F.when(c > 0, F.log(c)).otherwise(0.0)


def query_pairs(terms: DataFrame, fields: list[str], postings: DataFrame) -> DataFrame:
    """(topic, term, field, df, ttf, w, n): every query term in every field, 0 where the collection lacks it; w is the field's number of tokens."""
    held = postings.where(F.col("field").isin(fields))
    stats = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "field").agg(F.count_distinct("doc_id").alias("df"), F.sum("tf").alias("ttf"))
    sizes = held.groupBy("field").agg(F.sum("tf").alias("w"))
    n = postings.agg(F.count_distinct("doc_id").alias("n"))
    pairs = terms.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    out = pairs.join(stats, ["term", "field"], "left").join(F.broadcast(sizes), "field", "left").crossJoin(F.broadcast(n))  # one row a field, one row
    return out.na.fill(0, ["df", "ttf", "w"])


def saved_pairs(terms: DataFrame, fields: list[str], collection: Collection) -> DataFrame:
    """``query_pairs`` from the tables of a saved collection: no postings are read."""
    sizes = collection.averages.where(F.col("field").isin(fields)).select("field", F.col("tokens").alias("w"))
    pairs = terms.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    out = pairs.join(collection.statistics(terms, fields), ["term", "field"], "left").join(F.broadcast(sizes), "field", "left").crossJoin(F.broadcast(collection.n))  # one row a field, one row
    return out.na.fill(0, ["df", "ttf", "w"])


def idf_family(pairs: DataFrame) -> DataFrame:
    """(topic, avg_idf, sum_idf, max_idf, std_idf): avg over keywords, not pairs; a term that no document has counts idf 0; std is the sample's, 0 for one keyword."""
    value = F.when(F.col("df") > 0, idf(F.col("n"), F.col("df"))).otherwise(0.0)
    v = pairs.withColumn("v", value).groupBy("topic").agg(F.sum("v").alias("s"), F.count_distinct("term").alias("k"), F.max("v").alias("m"), F.stddev_samp("v").alias("sd"))
    return v.select("topic", (F.col("s") / F.col("k")).alias("avg_idf"), F.col("s").alias("sum_idf"), F.greatest(F.col("m"), F.lit(0.0)).alias("max_idf"), F.when(F.col("k") == 1, 0.0).otherwise(F.coalesce("sd", F.lit(0.0))).alias("std_idf"))


def avg_ictf(pairs: DataFrame) -> DataFrame:
    """(topic, avg_ictf, clarity): 1/|T| of the sum of log2 W - log2(1 + ttf); clarity = log2(1/|T|) + avg_ictf, the simplified clarity score."""
    value = F.when(F.col("w") > 0, F.log2(F.col("w"))).otherwise(0.0) - F.log2(1 + F.col("ttf"))
    a = pairs.groupBy("topic").agg((F.sum(value) / F.count_distinct("term")).alias("avg_ictf"), F.count_distinct("term").alias("m"))
    return a.select("topic", "avg_ictf", (F.log2(1 / F.col("m")) + F.col("avg_ictf")).alias("clarity"))


def scq(pairs: DataFrame) -> DataFrame:
    """(topic, scq): sum of (1 + ln ttf) ln(1 + N / df); unseen terms add nothing."""
    value = F.when(F.col("df") > 0, (1 + _guarded_log(F.col("ttf"))) * F.log(1 + F.col("n") / F.when(F.col("df") > 0, F.col("df")))).otherwise(0.0)
    return pairs.groupBy("topic").agg(F.sum(value).alias("scq"))


def collection_query_similarity(pairs: DataFrame) -> DataFrame:
    """(topic, sum_cqs, max_cqs, avg_cqs): per pair (1 + ln(1 + ttf)) ln(1 + idf)."""
    i = F.when(F.col("df") > 0, idf(F.col("n"), F.col("df"))).otherwise(0.0)
    value = (1 + F.log(1 + F.col("ttf"))) * F.log(1 + i)
    return pairs.groupBy("topic").agg(F.sum(value).alias("sum_cqs"), F.max(value).alias("max_cqs"), F.avg(value).alias("avg_cqs"))


def query_scope(retrieved: DataFrame, sizes: DataFrame) -> DataFrame:
    """(topic, query_scope): -ln((1 + retrieved) / (1 + sum of W)); ``sizes`` has (topic, w) of the query's distinct fields."""
    return retrieved.join(sizes, "topic").select("topic", (-F.log((1 + F.col("n")) / (1 + F.col("w")))).alias("query_scope"))


def term_containment(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(topic, tf): over the query's terms, the number of documents that contain each."""
    held = postings.join(terms.select("topic", "term").distinct(), "term").select("topic", "term", "doc_id").distinct()
    return held.groupBy("topic").agg(F.count(F.lit(1)).alias("tf"))


# After retrieval: ``run`` has topic, run_name, doc_id, score, rn (from 1).

KEYS = ["topic", "run_name"]


def clarity_score(run: DataFrame, postings: DataFrame, field: str = "ab", weight: float = 0.6) -> DataFrame:
    """(topic, clarity): divergence of the results' language model from the collection's, results weighted by their score over the mean."""
    stats = run.groupBy("topic").agg(F.sum("score").alias("s"))
    weighted = run.join(stats, "topic").select("topic", "doc_id", F.when(F.col("s") != 0, F.col("score") / F.col("s")).otherwise(0.0).alias("weight"))
    return kl_divergence(language_model(weighted, postings, field), jelinek_mercer(weight)).withColumnRenamed("kl", "clarity")


def _sizes(run: DataFrame, k: int) -> DataFrame:
    return run.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("len"), F.min("score").alias("d")).withColumn("k", F.greatest(F.least(F.lit(k), F.col("len")), F.lit(1)))


def nqc(run: DataFrame, k: int = 100) -> DataFrame:
    """(topic, run_name, nqc): standard deviation of the first k scores over the absolute last score of the run; 0 where that is 0."""
    top = run.where(F.col("rn") <= k).groupBy(*KEYS).agg(F.stddev_pop("score").alias("sd"))
    return top.join(_sizes(run, k), KEYS).select(*KEYS, F.when(F.col("d") != 0, F.col("sd") / F.abs("d")).otherwise(0.0).alias("nqc"))


def wig(run: DataFrame, query_length: DataFrame, k: int = 10, compat: bool = False) -> DataFrame:
    """(topic, run_name, wig): mean over the first k of (score - last score) / sqrt(query length). ``compat`` sums over all results."""
    sized = run.join(_sizes(run, k), KEYS)
    held = sized if compat else sized.where("rn <= k")
    return held.join(query_length, "topic").groupBy(*KEYS).agg((F.sum((F.col("score") - F.col("d")) / F.sqrt("query_length")) / F.first("k")).alias("wig"))


def weg(run: DataFrame, query_length: DataFrame, k: int = 10, compat: bool = False) -> DataFrame:
    """(topic, run_name, weg): as wig, with the mean of the last k scores in place of the last score."""
    sized = run.join(_sizes(run, k), KEYS)
    tail = sized.where(F.col("rn") > F.col("len") - F.col("k")).groupBy(*KEYS).agg(F.avg("score").alias("c"))
    held = (sized if compat else sized.where("rn <= k")).join(tail, KEYS)
    return held.join(query_length, "topic").groupBy(*KEYS).agg((F.sum((F.col("score") - F.col("c")) / F.sqrt("query_length")) / F.first("k")).alias("weg"))


