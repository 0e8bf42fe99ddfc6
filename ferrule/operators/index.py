"""Documents to postings and collection statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import STOPWORDS, sentences, terms
from ferrule.tables import table

FIELDS = ("ti", "ab", "mh")


def medline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ti, ab, mh, dcom): the current state of every record, the latest loaded_at; dcom as a date or null."""
    rows = table(spark, sf_dir, "medline").where("pmid IS NOT NULL")
    last = rows.groupBy("pmid").agg(F.max(F.struct("loaded_at", "ti", "ab", "mh", "dcom")).alias("r"))
    return last.select(F.col("pmid").alias("doc_id"), "r.ti", "r.ab", "r.mh", F.expr("CAST(try_to_timestamp(r.dcom, 'yyyyMMdd') AS DATE)").alias("dcom"))


def delivered_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, field, doc_id, tf, pos): the table of postings without null terms and repeated rows."""
    rows = table(spark, sf_dir, "postings").where("term IS NOT NULL AND pmid IS NOT NULL AND field IS NOT NULL")
    return rows.groupBy("term", "field", F.col("pmid").alias("doc_id")).agg(F.max("tf").alias("tf"), F.max("pos").alias("pos"))


def index(docs: DataFrame, term_filter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, field, doc_id, tf, pos) of the documents. ``term_filter`` says of a term of ti and ab whether it is kept, as a tagger of parts of speech would; all are without it.

    ti: position 1 + (1 - i / length) of the first occurrence i; ab: 1 + (1 - s / sentences) of the first sentence s; a heading
    of mh is one term with tf and pos 1. All fields of a document are counted within its row, before any shuffle.
    """
    ti = docs.select("doc_id", F.lit("ti").alias("field"), terms("ti").alias("ws")).where(F.size("ws") > 0)
    ti = ti.select("doc_id", "field", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "term"))
    ab = docs.select("doc_id", F.lit("ab").alias("field"), sentences("ab").alias("ss")).where(F.size("ss") > 0)
    ab = ab.select("doc_id", "field", F.size("ss").alias("n"), F.posexplode("ss").alias("i", "s")).select("doc_id", "field", "n", "i", F.explode(terms("s")).alias("term"))
    mh = docs.select("doc_id", F.lit("mh").alias("field"), F.explode("mh").alias("h")).where("h IS NOT NULL AND trim(h) <> ''").select("doc_id", "field", F.lower(F.trim("h")).alias("term")).distinct()
    words = ti.unionByName(ab)
    counted = (words if term_filter is None else words.where(term_filter(F.col("term")))).groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("tf"), (1.0 + (1.0 - F.min("i") / F.first("n"))).alias("pos"))
    return counted.unionByName(mh.select("term", "field", "doc_id", F.lit(1.0).alias("tf"), F.lit(1.0).alias("pos")))


def clean_index(docs: DataFrame, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(term, doc_id, tf) of ti and ab together without stop words and numbers."""
    text = F.concat_ws(" ", "ti", "ab")
    words = docs.select("doc_id", F.explode(terms(text)).alias("term"))
    return words.where(~F.col("term").isin(stopwords) & ~F.col("term").rlike("^[0-9]+$")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def doc_lengths(postings: DataFrame) -> DataFrame:
    """(doc_id, field, doc_len): occurrences per document and field."""
    return postings.groupBy("doc_id", "field").agg(F.sum("tf").alias("doc_len"))


def average_lengths(postings: DataFrame, n_docs: DataFrame | None = None) -> DataFrame:
    """(field, avg_doc_len): the mean over all documents, those without the field counting 0."""
    total = postings.agg(F.count_distinct("doc_id").alias("n")) if n_docs is None else n_docs
    return postings.groupBy("field").agg(F.sum("tf").alias("s")).crossJoin(F.broadcast(total)).select("field", (F.col("s") / F.col("n")).alias("avg_doc_len"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """(term, field, df, ttf)."""
    return postings.groupBy("term", "field").agg(F.count_distinct("doc_id").alias("df"), F.sum("tf").alias("ttf"))


def vocabulary_sizes(postings: DataFrame) -> DataFrame:
    """(field, tokens, terms): both meanings of the size of a vocabulary."""
    return postings.groupBy("field").agg(F.sum("tf").alias("tokens"), F.count_distinct("term").alias("terms"))


def term_vectors(postings: DataFrame) -> DataFrame:
    """(doc_id, field, term, tf, df, ttf)."""
    return postings.join(term_statistics(postings), ["term", "field"]).select("doc_id", "field", "term", "tf", "df", "ttf")


def document_vectors(postings: DataFrame) -> DataFrame:
    """(doc_id, terms): the (field, term) pairs that a document has, as a sorted array: the binary vector of the document."""
    return postings.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "field", "term"))).alias("terms"))


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def save_index(postings: DataFrame, folder: str) -> None:
    """Writes what every ranking needs once: the ``postings`` in order of term within each file, so that a query's terms prune row groups, and three tables of
    statistics: ``lengths`` (doc_id, field, dl, distinct_terms), ``terms`` (term, field, df, ttf) and ``fields`` (field, tokens, avgdl, n).

    ``postings`` has one row per (term, field, doc_id); n counts the documents of any field, and avgdl is over all of these.
    """
    spark = postings.sparkSession
    postings.sortWithinPartitions("term", "field").write.parquet(f"{folder}/postings")
    held = spark.read.parquet(f"{folder}/postings")
    held.groupBy("doc_id", "field").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("distinct_terms")).write.parquet(f"{folder}/lengths")
    held.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    lengths = spark.read.parquet(f"{folder}/lengths")
    n = lengths.agg(F.count_distinct("doc_id").alias("n"))
    sums = lengths.groupBy("field").agg(F.sum("dl").alias("tokens")).crossJoin(F.broadcast(n))  # one row
    sums.select("field", "tokens", (F.col("tokens") / F.col("n")).alias("avgdl"), "n").write.parquet(f"{folder}/fields")
