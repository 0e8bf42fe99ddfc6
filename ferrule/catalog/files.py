"""Files of retrieval experiments: the tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.evaluation import _data
from ferrule.catalog.learning import candidates
from ferrule.catalog.sql import QRELS, RUN
from ferrule.operators import index as ix
from ferrule.sources import readers, writers
from ferrule.tables import shared_folder, table


def _back(s, lines, read):
    path = shared_folder(s)
    writers.write_lines(lines, path)
    return read(s, path)


def file_run(s, d):
    """The results with all six columns, through a TREC run file; white space in a document's name does not survive it."""
    whole = table(s, d, "runs").where("topic IS NOT NULL AND trim(doc_id) <> '' AND rank IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND run_name IS NOT NULL")
    back = _back(s, writers.trec_lines(whole), readers.read_run)
    return back.groupBy("topic", "doc_id", "run_name").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"), F.round(F.max("score"), 6).alias("best"))


def file_qrels(s, d):
    """The pooled judgements through a file of relevance judgements."""
    _, qrels = _data(s, d)
    lines = qrels.select(F.concat_ws(" ", "topic", F.lit("0"), F.col("doc_id").cast("string"), F.col("grade").cast("string")).alias("value"))
    return _back(s, lines, readers.read_qrels).select("topic", F.col("doc_id").cast("long").alias("doc_id"), F.col("score").alias("grade"))


def file_pmids(s, d):
    """The numbers of all records through a list of numbers."""
    return _back(s, ix.medline_documents(s, d).select(F.col("doc_id").cast("string").alias("value")), readers.read_pmids)


def file_features(s, d):
    """(topic, score, comment, f, v): the candidates' features through a LIBSVM ranking file."""
    back = _back(s, writers.libsvm_rank_lines(candidates(s, d).withColumn("comment", F.col("candidate_id").cast("string"))), readers.read_libsvm_rank)
    return back.select("topic", "score", "comment", F.explode("features").alias("f", "v"))


def file_reinforcement(s, d):
    """(topic, comment, f, v, total): features and scores through a reinforcement file; missing scores come back as 0."""
    rows = table(s, d, "learnt_features").where("topic IS NOT NULL AND candidate_id IS NOT NULL AND scores IS NOT NULL AND features IS NOT NULL").withColumn("scores", F.transform("scores", lambda x: F.nanvl(x, F.lit(0.0))))
    back = _back(s, writers.reinforcement_lines(rows.withColumn("comment", F.col("candidate_id").cast("string"))), readers.read_reinforcement)
    held = back.select("topic", "comment", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total"), F.explode("features").alias("f", "v"))
    return held.groupBy("topic", "comment", "f", "v").agg(F.round(F.max("total"), 6).alias("total"))


def file_dates(s, d):
    """The first and last date of each year's records through a file of date restrictions."""
    dated = ix.medline_documents(s, d).where("dcom IS NOT NULL").groupBy(F.year("dcom").cast("string").alias("topic")).agg(F.min("dcom").alias("a"), F.max("dcom").alias("b"))
    lines = dated.select(F.concat_ws("\t", "topic", F.date_format("a", "yyyyMMdd"), F.date_format("b", "yyyyMMdd")).alias("value"))
    return _back(s, lines, readers.read_date_restrictions).select("topic", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


QUERIES = {f.__name__: f for f in (file_run, file_qrels, file_pmids, file_features, file_reinforcement, file_dates)}
ORACLES = {
    "file_run": r"""SELECT topic, trim(doc_id) AS doc_id, run_name, count(*) AS n, CAST(sum(rank) AS BIGINT) AS ranks, round(max(score), 6) AS best FROM runs
WHERE topic IS NOT NULL AND trim(doc_id) <> '' AND rank IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND run_name IS NOT NULL GROUP BY ALL""",
    "file_qrels": f"WITH {RUN}, {QRELS} SELECT topic, doc_id, grade FROM q",
    "file_pmids": "SELECT DISTINCT pmid AS doc_id FROM medline WHERE pmid IS NOT NULL",
    "file_features": """WITH c AS (SELECT topic, candidate_id, max(s) AS score, any_value(features) AS features FROM (SELECT *, scores[1] AS s FROM learnt_features)
  WHERE topic IS NOT NULL AND candidate_id IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) GROUP BY ALL)
SELECT topic, score, CAST(candidate_id AS VARCHAR) AS comment, unnest(map_keys(features)) AS f, unnest(map_values(features)) AS v FROM c""",
    "file_reinforcement": """SELECT topic, comment, f, v, round(max(total), 6) AS total FROM (SELECT topic, CAST(candidate_id AS VARCHAR) AS comment, unnest(map_keys(features)) AS f, unnest(map_values(features)) AS v,
  coalesce(list_sum(list_filter(scores, lambda x: x IS NOT NULL AND NOT isnan(x))), 0) AS total FROM learnt_features WHERE topic IS NOT NULL AND candidate_id IS NOT NULL AND scores IS NOT NULL AND features IS NOT NULL) GROUP BY ALL""",
    "file_dates": """SELECT CAST(year(dcom) AS VARCHAR) AS topic, CAST(min(dcom) AS VARCHAR) AS start, CAST(max(dcom) AS VARCHAR) AS "end" FROM (
  SELECT CAST(try_strptime(dcom, '%Y%m%d') AS DATE) AS dcom FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY loaded_at DESC NULLS LAST, ti DESC NULLS LAST, ab DESC NULLS LAST, mh DESC NULLS LAST, dcom DESC NULLS LAST) AS r
  FROM medline WHERE pmid IS NOT NULL) WHERE r = 1) WHERE dcom IS NOT NULL GROUP BY year(dcom)""",
}
