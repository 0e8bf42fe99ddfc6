"""Query performance predictors and language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.evaluation import _r
from ferrule.catalog.ranking import FIELDS, TOPICS, keyword_topics
from ferrule.catalog.saved import collection, postings
from ferrule.catalog.sql import POST, RUN, rounded, words
from ferrule.operators import evaluate as ev
from ferrule.operators import predictors as pr
from ferrule.operators import scorers as sc
from ferrule.operators import statistics as st
from ferrule.tables import table, written


def _pairs(s, d):
    return pr.saved_pairs(keyword_topics(s), FIELDS, collection(s, d))


def qpp_idf_family(s, d):
    return _r(pr.idf_family(_pairs(s, d)), "avg_idf", "sum_idf", "max_idf", "std_idf")


def qpp_avg_ictf_scs(s, d):
    return _r(pr.avg_ictf(_pairs(s, d)), "avg_ictf", "clarity")


def qpp_scq(s, d):
    return _r(pr.scq(_pairs(s, d)), "scq")


def qpp_cqs_family(s, d):
    return _r(pr.collection_query_similarity(_pairs(s, d)), "sum_cqs", "max_cqs", "avg_cqs")


def qpp_query_scope(s, d):
    c = collection(s, d)
    hits = c.matched(keyword_topics(s), FIELDS).groupBy("topic").agg(F.count_distinct("doc_id").alias("n"))
    sizes = keyword_topics(s).select("topic").distinct().crossJoin(F.broadcast(c.averages.where(F.col("field").isin(FIELDS)).agg(F.sum("tokens").alias("w"))))
    return _r(pr.query_scope(hits, sizes), "query_scope")


def qpp_tf(s, d):
    return pr.term_containment(keyword_topics(s), postings(s, d))


def _run(s, d):
    return ev.ranked(table(s, d, "runs"))


def _lengths(run):
    """Query length by topic: the characters of its name, as there are no query texts for these runs."""
    return run.select("topic").distinct().select("topic", F.length("topic").cast("double").alias("query_length"))


def qpp_nqc(s, d):
    return _r(pr.nqc(_run(s, d), 100), "nqc")


def qpp_wig(s, d):
    run = _run(s, d)
    return _r(pr.wig(run, _lengths(run), 10), "wig")


def qpp_wig_all(s, d):
    run = _run(s, d)
    return _r(pr.wig(run, _lengths(run), 10, compat=True), "wig")


def qpp_weg(s, d):
    run = _run(s, d)
    return _r(pr.weg(run, _lengths(run), 10), "weg")


def _weighted(s, d):
    scores = sc.bm25(collection(s, d), keyword_topics(s), ["ab"])
    return written(scores.select("topic", "doc_id", F.round("score", 6).alias("score")))


def qpp_clarity(s, d):
    return _r(pr.clarity_score(_weighted(s, d), postings(s, d)), "clarity")


def _model(s, d):
    return st.language_model(_weighted(s, d).withColumn("weight", F.lit(1.0)), postings(s, d), "ab")


def lm_probabilities(s, d):
    m = _model(s, d)
    return _r(m.select("topic", "term", st.jelinek_mercer(0.6).alias("jm"), st.dirichlet(1000.0).alias("dirichlet")), "jm", "dirichlet")


def lm_kl(s, d):
    return _r(st.kl_divergence(_model(s, d), st.dirichlet(1000.0)), "kl")


QUERIES = {f.__name__: f for f in (qpp_idf_family, qpp_avg_ictf_scs, qpp_scq, qpp_cqs_family, qpp_query_scope, qpp_tf, qpp_nqc, qpp_wig, qpp_wig_all, qpp_weg, qpp_clarity, lm_probabilities, lm_kl)}

_W = words(TOPICS)
_X = f"""{POST}, {_W}, x AS (SELECT w.topic, w.term, f.field, coalesce(df, 0) AS df, coalesce(ttf, 0) AS ttf, tokens, n, CASE WHEN df > 0 THEN ln((n + 1) / (df + 1)) ELSE 0 END AS i
FROM w CROSS JOIN (SELECT field, sum(tf) AS tokens FROM p WHERE field IN ('ti', 'ab') GROUP BY field) f CROSS JOIN (SELECT count(DISTINCT doc_id) AS n FROM p)
LEFT JOIN (SELECT term, field, count(*) AS df, sum(tf) AS ttf FROM p GROUP BY ALL) USING (term, field))"""
_BM = f"""{POST}, {_W}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p), dl AS (SELECT doc_id, sum(tf) AS dl FROM p WHERE field = 'ab' GROUP BY doc_id),
b AS (SELECT topic, doc_id, round(sum(ln((n + 1) / (df + 1)) * tf * 2.2 / (tf + 1.2 * (0.9 + 0.1 * dl / ((SELECT sum(dl) FROM dl) / n)))), 6) AS score FROM p JOIN w USING (term) JOIN dl USING (doc_id) CROSS JOIN n
JOIN (SELECT term, count(*) AS df FROM p WHERE field = 'ab' GROUP BY term) USING (term) WHERE field = 'ab' GROUP BY ALL)"""


def _lm(weight: str) -> str:
    return f"""{_BM}, lm AS (SELECT topic, term, c, ttf, sum(c) OVER (PARTITION BY topic) AS len, (SELECT sum(tf) FROM p WHERE field = 'ab') AS v
FROM (SELECT topic, term, sum(tf * wt) AS c FROM (SELECT topic, doc_id, {weight} AS wt FROM b) JOIN p USING (doc_id) WHERE field = 'ab' GROUP BY ALL) JOIN (SELECT term, sum(tf) AS ttf FROM p WHERE field = 'ab' GROUP BY term) USING (term))"""


_JM = "(0.6 * c / len + 0.4 * ttf / v)"
_DI = "((c + 1000 * ttf / v) / (len + 1000))"
_Z = f"{RUN}, z AS (SELECT *, count(*) OVER (PARTITION BY topic, run_name) AS len, min(score) OVER (PARTITION BY topic, run_name) AS last FROM r)"
ORACLES = {
    "qpp_idf_family": f"""WITH {_X} SELECT topic, {rounded('avg_idf sum_idf max_idf std_idf')} FROM (SELECT topic, sum(i) / count(DISTINCT term) AS avg_idf, sum(i) AS sum_idf, greatest(max(i), 0) AS max_idf,
CASE WHEN count(DISTINCT term) = 1 THEN 0 ELSE coalesce(stddev_samp(i), 0) END AS std_idf FROM x GROUP BY topic)""",
    "qpp_avg_ictf_scs": f"WITH {_X} SELECT topic, round(a, 6) AS avg_ictf, round(log2(1 / m) + a, 6) AS clarity FROM (SELECT topic, sum(log2(tokens) - log2(1 + ttf)) / count(DISTINCT term) AS a, count(DISTINCT term) AS m FROM x GROUP BY topic)",
    "qpp_scq": f"WITH {_X} SELECT topic, round(sum(CASE WHEN df > 0 THEN (1 + ln(ttf)) * ln(1 + n / df) ELSE 0 END), 6) AS scq FROM x GROUP BY topic",
    "qpp_cqs_family": f"WITH {_X}, y AS (SELECT topic, (1 + ln(1 + ttf)) * ln(1 + i) AS v FROM x) SELECT topic, round(sum(v), 6) AS sum_cqs, round(max(v), 6) AS max_cqs, round(avg(v), 6) AS avg_cqs FROM y GROUP BY topic",
    "qpp_query_scope": f"WITH {POST}, {_W} SELECT topic, round(-ln((1 + count(DISTINCT doc_id)) / (1 + (SELECT sum(tf) FROM p WHERE field IN ('ti', 'ab')))), 6) AS query_scope FROM p JOIN w USING (term) WHERE field IN ('ti', 'ab') GROUP BY topic",
    "qpp_tf": f"WITH {POST}, {_W} SELECT topic, count(DISTINCT (term, doc_id)) AS tf FROM p JOIN w USING (term) GROUP BY topic",
    "qpp_nqc": f"WITH {_Z} SELECT topic, run_name, round(CASE WHEN any_value(last) <> 0 THEN stddev_pop(score) FILTER (rn <= 100) / abs(any_value(last)) ELSE 0 END, 6) AS nqc FROM z GROUP BY ALL",
    "qpp_wig": f"WITH {_Z} SELECT topic, run_name, round(sum((score - last) / sqrt(length(topic))) / least(10, any_value(len)), 6) AS wig FROM z WHERE rn <= 10 GROUP BY ALL",
    "qpp_wig_all": f"WITH {_Z} SELECT topic, run_name, round(sum((score - last) / sqrt(length(topic))) / least(10, any_value(len)), 6) AS wig FROM z GROUP BY ALL",
    "qpp_weg": f"""WITH {_Z}, t AS (SELECT topic, run_name, avg(score) AS c FROM z WHERE rn > len - least(10, len) GROUP BY ALL)
SELECT topic, run_name, round(sum((score - c) / sqrt(length(topic))) / least(10, any_value(len)), 6) AS weg FROM z JOIN t USING (topic, run_name) WHERE rn <= 10 GROUP BY ALL""",
    "qpp_clarity": f"WITH {_lm('score / sum(score) OVER (PARTITION BY topic)')} SELECT topic, round(sum({_JM} * ln({_JM} / (ttf / v))), 6) AS clarity FROM lm GROUP BY topic",
    "lm_probabilities": f"WITH {_lm('1.0')} SELECT topic, term, round({_JM}, 6) AS jm, round({_DI}, 6) AS dirichlet FROM lm",
    "lm_kl": f"WITH {_lm('1.0')} SELECT topic, round(sum({_DI} * ln({_DI} / (ttf / v))), 6) AS kl FROM lm GROUP BY topic",
}
