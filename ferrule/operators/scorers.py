"""Scorers of documents for keyword queries, as aggregations of the postings that match.

``terms`` has (topic, term); each scorer gives (topic, doc_id, score) for the documents that hold a term in one of the
fields. Postings are cut to the query's terms before anything is joined; statistics that need all postings (document
lengths) are computed once, in ``Collection``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators.statistics import idf

#: Terms of queries that are named in the filter of a scan; more of them are joined.
FEW_TERMS = 1_000


@dataclass(frozen=True)
class Collection:
    """Postings, with documents (doc_id, dcom) where dates are wanted. One made by ``saved`` reads the statistics of ``index.save_index`` instead of all postings."""

    postings: DataFrame
    docs: DataFrame | None = None
    cache: dict = field(default_factory=dict, compare=False)

    @classmethod
    def saved(cls, spark: SparkSession, folder: str, docs: DataFrame | None = None) -> "Collection":
        fields, lengths, terms, postings = (spark.read.parquet(f"{folder}/{name}") for name in ("fields", "lengths", "terms", "postings"))
        return cls(postings, docs, {"n": fields.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")), "averages": fields.select("field", "avgdl", "tokens"), "lengths": lengths, "terms": terms})

    def _once(self, name: str, make) -> DataFrame:
        if name not in self.cache:
            self.cache[name] = make()
        return self.cache[name]

    @property
    def n(self) -> DataFrame:
        return self._once("n", lambda: self.postings.agg(F.count_distinct("doc_id").alias("n")))

    @property
    def lengths(self) -> DataFrame:
        return self._once("lengths", lambda: self.postings.groupBy("doc_id", "field").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("distinct_terms")))

    @property
    def averages(self) -> DataFrame:
        return self._once("averages", lambda: self.lengths.groupBy("field").agg(F.sum("dl").alias("s")).crossJoin(F.broadcast(self.n)).select("field", (F.col("s") / F.col("n")).alias("avgdl"), F.col("s").alias("tokens")))

    def wanted(self, terms: DataFrame, fields: list[str]) -> DataFrame:
        """The postings of the terms in the fields. Up to ``FEW_TERMS`` terms are handed to the scan, which then skips the row groups without them."""
        held = self.postings.where(F.col("field").isin(fields))
        few = [r.term for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
        return held.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else held.join(terms.select("term").distinct(), "term", "left_semi")

    def matched(self, terms: DataFrame, fields: list[str]) -> DataFrame:
        """(topic, term, field, doc_id, tf, pos): the wanted postings, once per topic."""
        return self.wanted(terms, fields).join(terms.select("topic", "term").distinct(), "term")

    def statistics(self, terms: DataFrame, fields: list[str]) -> DataFrame:
        """(term, field, df, ttf) of the query's terms only."""
        if "terms" in self.cache:
            return self.cache["terms"].where(F.col("field").isin(fields)).join(terms.select("term").distinct(), "term", "left_semi")
        return self.wanted(terms, fields).groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))

    def with_statistics(self, terms: DataFrame, fields: list[str]) -> DataFrame:
        return self.matched(terms, fields).join(self.statistics(terms, fields), ["term", "field"]).crossJoin(F.broadcast(self.n))


def _sum(matched: DataFrame, value: Column) -> DataFrame:
    return matched.groupBy("topic", "doc_id").agg(F.sum(value).alias("score"))


def sum_tf(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    return _sum(c.matched(terms, fields), F.col("tf"))


def sum_idf(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    """The sum of the query's idf over terms and fields: equal for all documents that match."""
    q = terms.select("topic", "term").distinct().join(c.statistics(terms, fields), "term").crossJoin(F.broadcast(c.n)).groupBy("topic").agg(F.sum(idf(F.col("n"), F.col("df"))).alias("score"))
    return c.matched(terms, fields).select("topic", "doc_id").distinct().join(q, "topic")


def tf_idf(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    """log10(sum of tf x sum of idf); 0 where the product is not positive."""
    both = sum_tf(c, terms, fields).withColumnRenamed("score", "t").join(sum_idf(c, terms, fields).withColumnRenamed("score", "i"), ["topic", "doc_id"])
    product = F.col("t") * F.col("i")
    return both.select("topic", "doc_id", F.when(product > 0, F.log10(product)).otherwise(0.0).alias("score"))


def bm25(c: Collection, terms: DataFrame, fields: list[str], k1: float = 1.2, b: float = 0.1) -> DataFrame:
    m = c.with_statistics(terms, fields).join(c.lengths.select("doc_id", "field", "dl"), ["doc_id", "field"]).join(F.broadcast(c.averages), "field")  # one row a field
    tf = F.col("tf")
    return _sum(m, idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))


def ln_l2(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    weight = F.log(F.col("n") + 1) / (F.col("df") + 0.5) / F.log(F.lit(2.0))
    return _sum(c.with_statistics(terms, fields), F.col("tf") * weight / (F.col("tf") + 1))


def dirichlet(c: Collection, terms: DataFrame, fields: list[str], mu: float = 2000.0) -> DataFrame:
    """Sum over matches of ln(1 + tf / (mu Pc)) + ln(mu / (dl + mu)), the published form."""
    m = c.with_statistics(terms, fields).join(c.lengths.select("doc_id", "field", "dl"), ["doc_id", "field"]).join(F.broadcast(c.averages), "field")
    return _sum(m, F.log(1 + F.col("tf") / (mu * F.col("ttf") / F.col("tokens"))) + F.log(mu / (F.col("dl") + mu)))


def vector_space(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    """Cosine of the binary vectors of query and document over (term, field)."""
    sizes = c.lengths.where(F.col("field").isin(fields)).groupBy("doc_id").agg(F.sum("distinct_terms").alias("d"))
    q = terms.select("topic", "term").distinct().groupBy("topic").agg((F.count(F.lit(1)) * len(fields)).alias("q"))
    m = c.matched(terms, fields).groupBy("topic", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    return m.join(sizes, "doc_id").join(q, "topic").select("topic", "doc_id", (F.col("m") / (F.sqrt("q") * F.sqrt("d"))).alias("score"))


def title_abstract(c: Collection, terms: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Per term by the fields that hold it: all 100; ti+ab 90; ti+mh or ab+mh 10; ti or ab 20; mh 90; none -100."""
    there = c.matched(terms, ["ti", "ab", "mh"]).groupBy("topic", "doc_id", "term").agg(*[F.max(F.col("field") == f).alias(f) for f in ("ti", "ab", "mh")])
    ti, ab, mh = F.col("ti"), F.col("ab"), F.col("mh")
    value = F.when(ti & ab & mh, 100).when(ti & ab, 90).when((ti | ab) & mh, 10).when(ti | ab, 20).otherwise(90)
    sums = there.groupBy("topic", "doc_id").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("k"))
    n = terms.select("topic", "term").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(n, "topic").select("topic", "doc_id", (F.col("s") - 100 * (F.col("n") - F.col("k"))).cast("double").alias("score"))


def position(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    return _sum(c.matched(terms, fields), F.col("pos"))


def publication_date(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    """Seconds since 1970 of the date of a matching document; 0 without a date."""
    hits = c.matched(terms, fields).select("topic", "doc_id").distinct()
    return hits.join(c.docs.select("doc_id", "dcom"), "doc_id", "left").select("topic", "doc_id", F.coalesce(F.unix_timestamp(F.col("dcom").cast("timestamp")), F.lit(0)).cast("double").alias("score"))


def document_length(c: Collection, terms: DataFrame, fields: list[str]) -> DataFrame:
    hits = c.matched(terms, fields).select("topic", "doc_id").distinct()
    sizes = c.lengths.where(F.col("field").isin(fields)).groupBy("doc_id").agg(F.sum("dl").alias("score"))
    return hits.join(sizes, "doc_id").select("topic", "doc_id", "score")


SCORERS = {
    "sum_tf": sum_tf, "sum_idf": sum_idf, "tf_idf": tf_idf, "bm25": bm25, "ln_l2": ln_l2, "dirichlet": dirichlet, "vector_space": vector_space,
    "title_abstract": title_abstract, "pos": position, "pub_date": publication_date, "doc_len": document_length,
}


def all_scores(c: Collection, routed: DataFrame, k1: float = 1.2, b: float = 0.1) -> DataFrame:
    """(topic, doc_id, bm25, ln_l2, pos, sum_tf, sum_idf, title_abstract, pub_date, doc_len): the scorers of many queries with fields of their own, together.

    ``routed`` has (topic, term, field). The wanted postings are read, joined with their statistics and aggregated once for all scorers.
    """
    routed = routed.distinct()
    held = c.wanted(routed, ["ti", "ab", "mh"]).join(routed.select("term", "field").distinct(), ["term", "field"], "left_semi")
    stats = c.cache["terms"].join(routed.select("term", "field").distinct(), ["term", "field"], "left_semi") if "terms" in c.cache else held.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    matched = held.join(routed, ["term", "field"])
    tf, weight = F.col("tf"), idf(F.col("n"), F.col("df"))
    m = matched.join(stats, ["term", "field"]).crossJoin(F.broadcast(c.n)).join(c.lengths.select("doc_id", "field", "dl"), ["doc_id", "field"]).join(F.broadcast(c.averages), "field")
    sums = m.groupBy("topic", "doc_id").agg(
        F.sum(weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("bm25"),
        F.sum(tf * F.log(F.col("n") + 1) / (F.col("df") + 0.5) / F.log(F.lit(2.0)) / (tf + 1)).alias("ln_l2"),
        F.sum("pos").alias("pos"), F.sum("tf").alias("sum_tf"),
    )
    query_idf = routed.join(stats, ["term", "field"]).crossJoin(F.broadcast(c.n)).groupBy("topic").agg(F.sum(weight).alias("sum_idf"))
    sizes = sums.select("topic", "doc_id").join(c.lengths.select("doc_id", "field", "dl"), "doc_id").join(routed.select("topic", "field").distinct(), ["topic", "field"]).groupBy("topic", "doc_id").agg(F.sum("dl").alias("doc_len"))
    places = title_abstract(c, routed.select("topic", "term")).withColumnRenamed("score", "title_abstract")
    dated = c.docs.select("doc_id", F.coalesce(F.unix_timestamp(F.col("dcom").cast("timestamp")), F.lit(0)).cast("double").alias("pub_date"))
    joined = sums.join(places, ["topic", "doc_id"]).join(sizes, ["topic", "doc_id"]).join(query_idf, "topic").join(dated, "doc_id", "left")
    return joined.na.fill(0.0, ["pub_date"])


def rank(scores: DataFrame, run_name: str, limit: int | None = None) -> DataFrame:
    """Run rows in order of falling score, then rising doc_id, ranks from 1; per-topic top lists are cut in every task first."""
    order = Window.partitionBy("topic").orderBy(F.col("score").desc(), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    if limit:
        out = out.where(F.col("rank") <= limit)
    return out.select("topic", F.lit("Q0").alias("iteration"), "doc_id", "rank", "score", F.lit(run_name).alias("run_name"))
