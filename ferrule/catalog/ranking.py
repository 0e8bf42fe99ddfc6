"""Scorers, ranking, normalisation and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.saved import collection
from ferrule.catalog.sql import CUR, POST, words
from ferrule.operators import fusion as fu
from ferrule.operators import scorers as sc
from ferrule.plans.ast import ABSTRACT, MESH, TITLE, Boolean, Keyword
from ferrule.tables import table

TOPICS = {"K1": ["thrombosis", "anticoagulation", "stroke"], "K2": ["insomnia", "depression", "anxiety", "zzzunseen"], "K3": ["asthma", "spirometry", "registry"], "K4": ["variance", "regression", "hypertension"]}
FIELDS = ["ti", "ab"]


def keyword_topics(s):
    return s.createDataFrame([(t, w) for t, ws in TOPICS.items() for w in ws], "topic string, term string")


def _scored(name):
    def run(s, d):
        scores = sc.SCORERS[name](collection(s, d), keyword_topics(s), FIELDS)
        return scores.select("topic", "doc_id", F.round(F.col("score").cast("double"), 6).alias("score"))

    return run


def rank_top(s, d):
    scores = sc.bm25(collection(s, d), keyword_topics(s), FIELDS).withColumn("score", F.round("score", 6))
    return sc.rank(scores, "bm25", 10)


def scorer_lists(s, d):
    """(topic, list_id, doc_id, score) of the table of scored documents: the latest usable score of each."""
    rows = table(s, d, "scored_docs").select("topic", F.lower(F.trim("scorer")).alias("list_id"), F.col("pmid").alias("doc_id"), "score", "scored_at").where(
        "topic IS NOT NULL AND list_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)"
    )
    return rows.groupBy("topic", "list_id", "doc_id").agg(F.max(F.struct("scored_at", "score")).alias("r")).select("topic", "list_id", "doc_id", "r.score")


def norm_minmax(s, d):
    return fu.min_max(scorer_lists(s, d)).withColumn("score", F.round("score", 6))


def fuse_combsum(s, d):
    return fu.comb_sum(fu.min_max(scorer_lists(s, d))).withColumn("score", F.round("score", 6))


def fuse_combmnz(s, d):
    return fu.comb_mnz(fu.min_max(scorer_lists(s, d))).withColumn("score", F.round("score", 6))


def rank_position_score(s, d):
    return fu.position_scores(scorer_lists(s, d)).withColumn("score", F.round("score", 6))


def gain_cutoff(s, d):
    sums = fu.comb_sum(fu.min_max(scorer_lists(s, d))).withColumn("score", F.round("score", 6))
    return fu.gain_cut(sums, 0.5)


def fuse_clm(s, d):
    matched = collection(s, d).matched(keyword_topics(s), FIELDS).select("topic", F.col("term").alias("clause"), "doc_id")
    return fu.coordination_level(matched)


TREE = Boolean("or", (Boolean("and", (Keyword("thrombosis", (TITLE, ABSTRACT)), Keyword("registry", (ABSTRACT,)))), Keyword("hypertension", (MESH,))))


def fuse_clf_tree(s, d):
    return fu.fuse_tree({"T1": TREE}, collection(s, d), ("bm25", "pos")).withColumn("score", F.round("score", 5))


def fuse_all_scorers(s, d):
    return fu.fuse_tree({"T1": TREE}, collection(s, d)).withColumn("score", F.round("score", 4))


QUERIES = {f"rank_{n}": _scored(n) for n in sc.SCORERS} | {f.__name__: f for f in (rank_top, norm_minmax, fuse_combsum, fuse_combmnz, rank_position_score, gain_cutoff, fuse_clm, fuse_clf_tree, fuse_all_scorers)}

_W = words(TOPICS)
_BASE = f"""{POST}, {CUR}, {_W}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p),
st AS (SELECT term, field, count(*) AS df, sum(tf) AS ttf FROM p WHERE term IN (SELECT term FROM w) GROUP BY ALL),
dl AS (SELECT doc_id, field, sum(tf) AS dl, count(*) AS dt FROM p GROUP BY ALL), av AS (SELECT field, sum(dl) / (SELECT n FROM n) AS avgdl, sum(dl) AS tokens FROM dl GROUP BY field),
m AS (SELECT w.topic, p.*, df, ttf, dl, avgdl, tokens, n.n, ln((n.n + 1) / (df + 1)) AS idf FROM p JOIN w USING (term) JOIN st USING (term, field) JOIN dl USING (doc_id, field) JOIN av USING (field) CROSS JOIN n WHERE field IN ('ti', 'ab')),
qi AS (SELECT topic, sum(ln((n + 1) / (df + 1))) AS si FROM w JOIN st USING (term) CROSS JOIN n WHERE field IN ('ti', 'ab') GROUP BY topic)"""


def _agg(value: str) -> str:
    return f"WITH {_BASE} SELECT topic, doc_id, round(sum({value}), 6) AS score FROM m GROUP BY ALL"


_BM25 = "idf * tf * 2.2 / (tf + 1.2 * (0.9 + 0.1 * dl / avgdl))"
_LISTS = """l AS (SELECT topic, list_id, doc_id, score FROM (
  SELECT topic, lower(trim(scorer)) AS list_id, pmid AS doc_id, score, row_number() OVER (PARTITION BY topic, lower(trim(scorer)), pmid ORDER BY scored_at DESC NULLS LAST, score DESC) AS k
  FROM scored_docs WHERE topic IS NOT NULL AND scorer IS NOT NULL AND pmid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) WHERE k = 1),
x AS (SELECT topic, list_id, doc_id, CASE WHEN max(score) OVER g > min(score) OVER g THEN (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) ELSE 0 END AS score FROM l WINDOW g AS (PARTITION BY topic, list_id))"""
_LEAVES = {"a": ("'ti', 'ab'", "thrombosis"), "b": ("'ab'", "registry"), "c": ("'mh'", "hypertension")}


def _tree_sql(scorers: dict[str, str], digits: int) -> str:
    """The tree (a and b) or c with its leaves fused from ``scorers``."""
    lists = " UNION ALL ".join(
        f"SELECT '{leaf}' AS leaf, '{name}' AS s, doc_id, {value} AS v FROM m WHERE leaf = '{leaf}' GROUP BY doc_id" for leaf in _LEAVES for name, value in scorers.items()
    )
    hits = " UNION ALL ".join(f"SELECT '{leaf}' AS leaf, p.* FROM p WHERE field IN ({fields}) AND term = '{w}'" for leaf, (fields, w) in _LEAVES.items())
    scale = "CASE WHEN max(v) OVER g > min(v) OVER g THEN (v - min(v) OVER g) / (max(v) OVER g - min(v) OVER g) ELSE 0 END + 1"
    return f"""WITH {POST}, {CUR}, n AS (SELECT count(DISTINCT doc_id) AS n FROM p), dl AS (SELECT doc_id, field, sum(tf) AS dl FROM p GROUP BY ALL),
av AS (SELECT field, sum(dl) / (SELECT n FROM n) AS avgdl FROM dl GROUP BY field), h AS ({hits}),
hm AS (SELECT h.*, count(*) OVER (PARTITION BY leaf, field) AS df, dl, avgdl, n.n FROM h JOIN dl USING (doc_id, field) JOIN av USING (field) CROSS JOIN n),
any_ AS (SELECT leaf, doc_id, bool_or(f = 'ti') AS ti, bool_or(f = 'ab') AS ab, bool_or(f = 'mh') AS mh FROM (
  SELECT 'a' AS leaf, doc_id, field AS f FROM p WHERE term = 'thrombosis' UNION ALL SELECT 'b', doc_id, field FROM p WHERE term = 'registry' UNION ALL SELECT 'c', doc_id, field FROM p WHERE term = 'hypertension') GROUP BY ALL),
alldl AS (SELECT 'a' AS leaf, doc_id, sum(dl) AS dsum FROM dl WHERE field IN ('ti', 'ab') GROUP BY doc_id UNION ALL SELECT 'b', doc_id, sum(dl) FROM dl WHERE field = 'ab' GROUP BY doc_id UNION ALL SELECT 'c', doc_id, sum(dl) FROM dl WHERE field = 'mh' GROUP BY doc_id),
m AS (SELECT hm.*, ln((n + 1) / (df + 1)) AS idf, dsum, dcom, (SELECT sum(ln((z.n + 1) / (z.df + 1))) FROM (SELECT DISTINCT leaf, field, df, n FROM hm) z WHERE z.leaf = hm.leaf) AS si
  FROM hm LEFT JOIN alldl USING (leaf, doc_id) LEFT JOIN cur USING (doc_id)),
lists AS ({lists}{_TA if 'title_abstract' in scorers or len(scorers) > 2 else ''}),
f AS (SELECT leaf, s, doc_id, {scale} AS v FROM lists WINDOW g AS (PARTITION BY leaf, s)),
e AS (SELECT leaf, doc_id, sum(v) * count(*) FILTER (v > 0) AS v FROM f GROUP BY ALL), k AS (SELECT leaf, doc_id, {scale} AS v FROM e WINDOW g AS (PARTITION BY leaf)),
u AS (SELECT doc_id, sum(v) AS v FROM k WHERE leaf IN ('a', 'b') GROUP BY doc_id UNION ALL SELECT doc_id, v FROM k WHERE leaf = 'c')
SELECT 'T1' AS topic, doc_id, round(sum(v) * count(*) FILTER (v > 0), {digits}) AS score FROM u GROUP BY doc_id"""


_TA = """ UNION ALL SELECT leaf, 'title_abstract', doc_id, CASE WHEN ti AND ab AND mh THEN 100 WHEN ti AND ab THEN 90 WHEN (ti OR ab) AND mh THEN 10 WHEN ti OR ab THEN 20 ELSE 90 END FROM any_ SEMI JOIN h USING (leaf, doc_id)"""
ORACLES = {
    "rank_sum_tf": _agg("tf"),
    "rank_sum_idf": f"WITH {_BASE} SELECT DISTINCT topic, doc_id, round(si, 6) AS score FROM m JOIN qi USING (topic)",
    "rank_tf_idf": f"WITH {_BASE} SELECT topic, doc_id, round(CASE WHEN sum(tf) * any_value(si) > 0 THEN log10(sum(tf) * any_value(si)) ELSE 0 END, 6) AS score FROM m JOIN qi USING (topic) GROUP BY ALL",
    "rank_bm25": _agg(_BM25),
    "rank_ln_l2": _agg("tf * ln(n + 1) / (df + 0.5) / ln(2) / (tf + 1)"),
    "rank_dirichlet": _agg("ln(1 + tf / (2000 * ttf / tokens)) + ln(2000 / (dl + 2000))"),
    "rank_vector_space": f"""WITH {_BASE} SELECT topic, doc_id, round(count(*) / (sqrt(any_value(q)) * sqrt(any_value(d))), 6) AS score FROM m
JOIN (SELECT doc_id, sum(dt) AS d FROM dl WHERE field IN ('ti', 'ab') GROUP BY doc_id) USING (doc_id) JOIN (SELECT topic, 2 * count(*) AS q FROM w GROUP BY topic) USING (topic) GROUP BY ALL""",
    "rank_title_abstract": f"""WITH {_BASE}, h AS (SELECT topic, doc_id, term, bool_or(field = 'ti') AS ti, bool_or(field = 'ab') AS ab, bool_or(field = 'mh') AS mh FROM p JOIN w USING (term) GROUP BY ALL)
SELECT topic, doc_id, round(CAST(sum(CASE WHEN ti AND ab AND mh THEN 100 WHEN ti AND ab THEN 90 WHEN ti AND mh OR ab AND mh THEN 10 WHEN ti OR ab THEN 20 ELSE 90 END) - 100 * (any_value(k) - count(*)) AS DOUBLE), 6) AS score
FROM h JOIN (SELECT topic, count(*) AS k FROM w GROUP BY topic) USING (topic) GROUP BY ALL""",
    "rank_pos": _agg("pos"),
    "rank_pub_date": f"WITH {_BASE} SELECT DISTINCT topic, doc_id, coalesce(CAST(epoch(dcom) AS DOUBLE), 0) AS score FROM m LEFT JOIN cur USING (doc_id)",
    "rank_doc_len": f"WITH {_BASE} SELECT topic, doc_id, any_value(d) AS score FROM m JOIN (SELECT doc_id, sum(dl) AS d FROM dl WHERE field IN ('ti', 'ab') GROUP BY doc_id) USING (doc_id) GROUP BY ALL",
    "rank_top": f"""WITH {_BASE} SELECT topic, 'Q0' AS iteration, doc_id, rank, score, 'bm25' AS run_name FROM (
SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM (SELECT topic, doc_id, round(sum({_BM25}), 6) AS score FROM m GROUP BY ALL)) WHERE rank <= 10""",
    "norm_minmax": f"WITH {_LISTS} SELECT topic, list_id, doc_id, round(score, 6) AS score FROM x",
    "fuse_combsum": f"WITH {_LISTS} SELECT topic, doc_id, round(sum(score), 6) AS score FROM x GROUP BY ALL",
    "fuse_combmnz": f"WITH {_LISTS} SELECT topic, doc_id, round(sum(score) * count(*) FILTER (score > 0), 6) AS score FROM x GROUP BY ALL",
    "rank_position_score": f"WITH {_LISTS} SELECT topic, list_id, doc_id, round(1 - row_number() OVER (PARTITION BY topic, list_id ORDER BY score DESC, doc_id) / count(*) OVER (PARTITION BY topic, list_id), 6) AS score FROM l",
    "gain_cutoff": f"""WITH {_LISTS}, s AS (SELECT topic, doc_id, round(sum(score), 6) AS score FROM x GROUP BY ALL)
SELECT topic, doc_id, score FROM (SELECT *, coalesce(sum(score) OVER (PARTITION BY topic ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(score) OVER (PARTITION BY topic) AS total FROM s) WHERE total > 0 AND before <= 0.5 * total""",
    "fuse_clm": f"WITH {POST}, {_W} SELECT topic, doc_id, CAST(count(DISTINCT term) AS DOUBLE) AS score FROM p JOIN w USING (term) WHERE field IN ('ti', 'ab') GROUP BY ALL",
    "fuse_clf_tree": _tree_sql({"bm25": f"sum({_BM25})", "pos": "sum(pos)"}, 5),
    "fuse_all_scorers": _tree_sql({
        "bm25": f"sum({_BM25})", "ln_l2": "sum(tf * ln(n + 1) / (df + 0.5) / ln(2) / (tf + 1))", "pos": "sum(pos)", "sum_idf": "any_value(si)", "pub_date": "any_value(coalesce(epoch(dcom), 0))", "doc_len": "any_value(dsum)",
    }, 4),
}
