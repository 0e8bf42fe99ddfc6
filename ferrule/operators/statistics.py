"""One statistics source over postings: collection statistics, language models and term probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators import index as ix


def idf(n: Column, nt: Column) -> Column:
    return F.log((n + 1) / (nt + 1))


@dataclass(frozen=True)
class StatisticsSource:
    """Statistics over a postings table (term, field, doc_id, tf, pos). ``vocab_mode`` is 'tokens' or 'terms'."""

    postings: DataFrame
    vocab_mode: str = "tokens"
    size: int = 1000

    def collection_size(self) -> DataFrame:
        return self.postings.agg(F.count_distinct("doc_id").alias("n"))

    def term_frequency(self, term: str, field: str) -> DataFrame:
        """(doc_id, tf) of the documents that hold the term."""
        return self.postings.where((F.col("term") == term.lower()) & (F.col("field") == field)).select("doc_id", "tf")

    def term_statistics(self, terms: list[str] | None = None) -> DataFrame:
        """(term, field, df, ttf), of ``terms`` only where given: the filter reaches the scan."""
        held = self.postings if terms is None else self.postings.where(F.col("term").isin([t.lower() for t in terms]))
        return ix.term_statistics(held)

    def vocabulary_size(self) -> DataFrame:
        return ix.vocabulary_sizes(self.postings).select("field", F.col(self.vocab_mode).cast("double").alias("vocabulary_size"))

    def inverse_document_frequency(self, terms: list[str] | None = None) -> DataFrame:
        """(term, field, idf): ln((N + 1) / (df + 1))."""
        stats = self.term_statistics(terms).crossJoin(F.broadcast(self.collection_size()))
        return stats.select("term", "field", idf(F.col("n"), F.col("df")).alias("idf"))

    def term_vector(self) -> DataFrame:
        return ix.term_vectors(self.postings)


def language_model(run: DataFrame, postings: DataFrame, field: str, weights: bool = True) -> DataFrame:
    """(topic, term, term_count, ttf, doc_len, vocabulary): the model of each topic's documents.

    ``run`` has topic, doc_id and weight; term_count = sum of tf x weight over the topic's documents, ttf and vocabulary the collection's.
    """
    here = postings.where(F.col("field") == field)
    stats = here.groupBy("term").agg(F.sum("tf").alias("ttf"))
    vocabulary = here.agg(F.sum("tf").alias("vocabulary"))
    weight = F.col("weight") if weights else F.lit(1.0)
    counted = run.join(here, "doc_id").groupBy("topic", "term").agg(F.sum(F.col("tf") * weight).alias("term_count"))
    length = counted.groupBy("topic").agg(F.sum("term_count").alias("doc_len"))
    return counted.join(length, "topic").join(stats, "term").crossJoin(F.broadcast(vocabulary))


def document_probability() -> Column:
    return F.when(F.col("doc_len") > 0, F.col("term_count") / F.col("doc_len")).otherwise(0.0)


def collection_probability() -> Column:
    return F.when(F.col("vocabulary") > 0, F.col("ttf") / F.col("vocabulary")).otherwise(0.0)


def jelinek_mercer(weight: float) -> Column:
    return weight * document_probability() + (1 - weight) * collection_probability()


def dirichlet(mu: float) -> Column:
    return (F.col("term_count") + mu * collection_probability()) / (F.col("doc_len") + mu)


def kl_divergence(model: DataFrame, probability: Column) -> DataFrame:
    """(topic, kl): sum over terms of p ln(p / q) against the collection; terms of probability 0 add nothing."""
    pq = model.select("topic", probability.alias("p"), collection_probability().alias("q"))
    return pq.where("p > 0 AND q > 0").groupBy("topic").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))
