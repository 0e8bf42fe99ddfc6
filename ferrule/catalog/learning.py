"""Sampling and selection of candidate queries, and their feature files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.evaluation import _r
from ferrule.catalog.saved import postings
from ferrule.catalog.sql import POST, number, tree_sql
from ferrule.catalog.structure import clauses
from ferrule.operators import index as ix
from ferrule.operators import learning as le
from ferrule.operators import sampling as sa
from ferrule.plans.parsers import parse_expression, parse_medline
from ferrule.plans.variations import Candidate, variations
from ferrule.sources import writers
from ferrule.sources.readers import parse_column
from ferrule.tables import table, written


def candidates(s, d):
    """(topic, candidate_id, transformation_id, score, features): each candidate with a first score once; a null transformation is 0."""
    rows = table(s, d, "learnt_features").where("topic IS NOT NULL AND candidate_id IS NOT NULL").withColumn("score", F.get("scores", F.lit(0))).where("score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("topic", "candidate_id").agg(F.coalesce(F.max("transformation_id"), F.lit(0)).alias("transformation_id"), F.max("score").alias("score"), F.first("features", ignorenulls=True).alias("features"))


ID = ["topic", "candidate_id"]


def sample_balanced(s, d):
    return sa.balanced(candidates(s, d), 0.1, 4).select(*ID, "transformation_id")


def sample_stratified(s, d):
    return sa.stratified(candidates(s, d), 0.1, 4).select(*ID, "transformation_id")


def sample_random(s, d):
    return sa.random(candidates(s, d), 0.1, 4, 7).select(*ID)


def sample_scored_balanced(s, d):
    return sa.balanced_scored(candidates(s, d), 4).select(*ID, "score")


def _baselines(s, d):
    return candidates(s, d).groupBy("topic").agg(F.round(F.avg("score"), 9).alias("baseline"))


def sample_positive_negative(s, d):
    c, b = candidates(s, d), _baselines(s, d)
    return sa.against_baseline(c, b, 3, "positive").select(F.lit("positive").alias("side"), *ID).unionByName(sa.against_baseline(c, b, 3, "negative").select(F.lit("negative").alias("side"), *ID))


def sample_scored_stratified(s, d):
    return sa.against_baseline(candidates(s, d), _baselines(s, d), 5, "stratified").select(*ID)


#: A first query for each heading; a heading's documents are the relevant ones.
STARTS = {
    "hypertension": "1. (blood adj2 pressure).ti,ab.\n2. hypertens$.ti,ab.\n3. or/1-2\n4. patient$.ab.\n5. 3 and 4",
    "anxiety": "(anxiety.ti,ab. or panic.ti,ab.) and exp Anxiety/",
    "sepsis": "(exp Sepsis/ or sepsis.ti.) not malaria.ab.",
}


def executed_queries() -> dict[str, list[Candidate]]:
    """Per heading its first query and every query one edit away."""
    parsed = {t: Candidate(parse_medline(q) if q.startswith("1.") else parse_expression(q), -1) for t, q in STARTS.items()}
    return {t: [c, *variations(c)] for t, c in parsed.items()}


def candidate_results(s, d):
    """What each candidate retrieves, with its F1."""
    return _r(le.f1_scored(_executed(s, d)), "score")


def _executed(s, d):
    judged = ix.delivered_postings(s, d).where(F.col("field").eqNullSafe("mh") & F.col("term").isin(list(STARTS))).select(F.col("term").alias("topic"), "doc_id")
    return le.executed(executed_queries(), postings(s, d), judged)


def sample_greedy(s, d):
    return sa.greedy(candidate_results(s, d), 4, "ret").select(*ID, "ret")


def sample_evaluated(s, d):
    """Candidates spread evenly over the F1 that they reach."""
    return sa.balanced_scored(candidate_results(s, d), 5).select(*ID, "score")


def sample_mmr(s, d):
    return sa.maximal_marginal_relevance(candidates(s, d), 4)


def sample_clusters(s, d):
    return sa.clustered(candidates(s, d), 4).select(*ID, "cluster")


def select_best(s, d):
    return le.best_of(candidates(s, d)).select(*ID, "score")


def select_random(s, d):
    return le.random_choice(candidates(s, d), 3).select(*ID)


def select_oracle(s, d):
    """The candidate that retrieves no less of the relevant than the first query, and no more in all."""
    c = written(_executed(s, d))
    current = c.where("candidate_id = 0").select("topic", F.col("rel_ret").alias("cur_rel_ret"), F.col("ret").alias("cur_ret"))
    return le.oracle(c.where("candidate_id > 0"), current).select(*ID, "rel_ret", "ret")


def average_scores(s, d):
    rows = table(s, d, "learnt_features").where("topic IS NOT NULL AND candidate_id IS NOT NULL")
    return le.average_scores(rows).groupBy(*ID).agg(F.round(F.max("average_score"), 9).alias("average_score"))


def nearest_cosines(s, d):
    c = candidates(s, d)
    return _r(le.cosines(c, le.train_nearest(c)), "cosine")


def select_nearest(s, d):
    c = candidates(s, d)
    return _r(le.nearest_selector(c, le.train_nearest(c)), "cosine")


def select_ranker(s, d):
    c = candidates(s, d)
    return le.select_by(le.train_ranker(c), c)


def features_libsvm(s, d):
    return writers.libsvm_rank_lines(candidates(s, d).withColumn("comment", F.col("candidate_id").cast("string")))


def explored_candidates(s, d):
    """(hash, candidate_id, transformation_id, depth, query): all candidates within two edits of every clause, breadth first."""
    import pandas as pd

    from ferrule.plans.ast import from_json

    def go(batches):
        for pdf in batches:
            rows = [(h, i, c.transformation, c.depth, str(c.query)) for h, q in zip(pdf["hash"], pdf["query"]) if q is not None for i, c in enumerate(le.breadth_first(Candidate(from_json(q), -1), lambda level: level, 2))]
            yield pd.DataFrame(rows, columns=["hash", "candidate_id", "transformation_id", "depth", "query"])

    return parse_column(clauses(s, d), "hash", "query").select("hash", "query").mapInPandas(go, "hash long, candidate_id long, transformation_id int, depth int, query string")


QUERIES = {f.__name__: f for f in (
    sample_balanced, sample_stratified, sample_random, sample_scored_balanced, sample_positive_negative, sample_scored_stratified, candidate_results, sample_greedy, sample_evaluated, sample_mmr, sample_clusters, select_best, select_random, select_oracle,
    average_scores, nearest_cosines, select_nearest, select_ranker, features_libsvm, explored_candidates,
)}
_C = """c AS (SELECT topic, candidate_id, coalesce(max(transformation_id), 0) AS tid, max(s) AS score, any_value(features) AS features FROM (
  SELECT *, scores[1] AS s FROM learnt_features) WHERE topic IS NOT NULL AND candidate_id IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) GROUP BY ALL),
z AS (SELECT *, count(*) OVER (PARTITION BY topic) AS len, row_number() OVER (PARTITION BY topic ORDER BY score DESC, candidate_id) AS best FROM c)"""
_RANDOM = "((candidate_id % 1000003) * 7919 + {} * 104729) % 1000003"
_B = "b AS (SELECT topic, round(avg(score), 9) AS baseline FROM c GROUP BY topic), u AS (SELECT z.*, score >= baseline AS up FROM z JOIN b USING (topic))"
_COS = """f AS (SELECT topic, candidate_id, unnest(map_keys(features)) AS f, unnest(map_values(features)) AS v FROM c),
g AS (SELECT topic AS mt, f, v AS w FROM f WHERE (topic, candidate_id) IN (SELECT (topic, candidate_id) FROM z WHERE best = 1)),
na AS (SELECT topic, candidate_id, sqrt(sum(v * v)) AS na FROM f GROUP BY ALL), nb AS (SELECT mt, sqrt(sum(w * w)) AS nb FROM g GROUP BY ALL),
k AS (SELECT topic, candidate_id, mt AS model_topic, sum(v * w) / any_value(na) / any_value(nb) AS cosine FROM f JOIN g USING (f) JOIN na USING (topic, candidate_id) JOIN nb USING (mt) WHERE v <> 0 AND w <> 0 GROUP BY ALL)"""
_EXECUTED = f"""WITH {POST}, j AS (SELECT DISTINCT term AS topic, doc_id FROM p WHERE field = 'mh' AND term IN ({", ".join(f"'{t}'" for t in STARTS)})),
q AS ({" UNION ALL ".join(f"SELECT '{t}' AS topic, {i} AS candidate_id, {c.transformation} AS transformation_id" for t, cs in executed_queries().items() for i, c in enumerate(cs))}),
h AS ({" UNION ALL ".join(f"SELECT '{t}' AS topic, {i} AS candidate_id, doc_id FROM ({tree_sql(c.query)})" for t, cs in executed_queries().items() for i, c in enumerate(cs))}),
n AS (SELECT topic, candidate_id, count(*) AS ret, count(j.doc_id) AS rel_ret FROM h LEFT JOIN j USING (topic, doc_id) GROUP BY ALL), l AS (SELECT topic, count(*) AS rel FROM j GROUP BY topic),
e AS (SELECT topic, candidate_id, transformation_id, coalesce(ret, 0) AS ret, coalesce(rel_ret, 0) AS rel_ret, coalesce(rel, 0) AS rel, CASE WHEN rel_ret > 0 THEN 2 * rel_ret / (ret + rel) ELSE 0 END AS f1
  FROM q LEFT JOIN n USING (topic, candidate_id) LEFT JOIN l USING (topic))"""
ORACLES = {
    "sample_balanced": f"""WITH {_C}, t AS (SELECT *, row_number() OVER (PARTITION BY topic, tid ORDER BY candidate_id) AS i FROM z)
SELECT topic, candidate_id, tid AS transformation_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY i, tid, candidate_id) AS k FROM t) WHERE k <= floor(len * 0.1) + 4""",
    "sample_stratified": f"""WITH {_C}, t AS (SELECT *, row_number() OVER (PARTITION BY topic, tid ORDER BY candidate_id) AS i, count(*) OVER (PARTITION BY topic, tid) AS m FROM z)
SELECT topic, candidate_id, tid AS transformation_id FROM t WHERE i <= ceil((floor(len * 0.1) + 4) * m / len)""",
    "sample_random": f"WITH {_C} SELECT topic, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_RANDOM.format(7)}, candidate_id) AS k FROM z) WHERE k <= floor(len * 0.1) + 4",
    "select_random": f"WITH {_C} SELECT topic, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY {_RANDOM.format(3)}, candidate_id) AS k FROM z) WHERE k = 1",
    "sample_scored_balanced": f"WITH {_C} SELECT topic, candidate_id, score FROM z WHERE (best - 1) % CAST(ceil(len / 4) AS BIGINT) = 0",
    "sample_positive_negative": f"""WITH {_C}, {_B} SELECT CASE WHEN up THEN 'positive' ELSE 'negative' END AS side, topic, candidate_id
FROM (SELECT *, row_number() OVER (PARTITION BY topic, up ORDER BY score DESC, candidate_id) AS i FROM u) WHERE i <= 3""",
    "sample_scored_stratified": f"""WITH {_C}, {_B} SELECT topic, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY topic, up ORDER BY score DESC, candidate_id) AS i, count(*) OVER (PARTITION BY topic, up) AS m FROM u) WHERE i <= ceil(5 * m / len)""",
    "candidate_results": f"{_EXECUTED} SELECT topic, candidate_id, transformation_id, ret, rel_ret, rel, round(f1, 6) AS score FROM e",
    "sample_greedy": f"{_EXECUTED} SELECT topic, candidate_id, ret FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ret, round(f1, 6) DESC, candidate_id) AS i FROM e) WHERE i <= 4",
    "sample_evaluated": f"""{_EXECUTED} SELECT topic, candidate_id, round(f1, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(f1, 6) DESC, candidate_id) AS i, count(*) OVER (PARTITION BY topic) AS len FROM e)
WHERE (i - 1) % CAST(ceil(len / 5) AS BIGINT) = 0""",
    "select_best": f"WITH {_C} SELECT topic, candidate_id, score FROM z WHERE best = 1",
    "select_oracle": f"""{_EXECUTED} SELECT topic, candidate_id, rel_ret, ret FROM (SELECT e.*, row_number() OVER (PARTITION BY topic ORDER BY e.rel_ret DESC, e.ret, e.candidate_id) AS i
FROM e JOIN (SELECT topic, ret AS r0, rel_ret AS rr0 FROM e WHERE candidate_id = 0) USING (topic) WHERE candidate_id > 0 AND rel_ret >= rr0 AND ret <= r0) WHERE i = 1""",
    "average_scores": """SELECT topic, candidate_id, round(max(a), 9) AS average_score FROM (SELECT topic, candidate_id, list_avg(list_filter(scores, lambda x: x IS NOT NULL AND NOT isnan(x))) AS a FROM learnt_features)
WHERE topic IS NOT NULL AND candidate_id IS NOT NULL GROUP BY ALL""",
    "nearest_cosines": f"WITH {_C}, {_COS} SELECT topic, candidate_id, model_topic, round(cosine, 6) AS cosine FROM k",
    "select_nearest": f"""WITH {_C}, {_COS} SELECT topic, candidate_id, model_topic, round(cosine, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(cosine, 9) DESC, candidate_id, model_topic) AS i FROM k WHERE topic <> model_topic) WHERE i = 1""",
    "features_libsvm": f"""WITH {_C}, x AS (SELECT topic, candidate_id, score, unnest(map_keys(features)) AS f, unnest(map_values(features)) AS v FROM c)
SELECT ({number('any_value(score)')}) || ' qid:' || topic || ' ' || string_agg(f || ':' || ({number('v')}), ' ' ORDER BY f) || ' # ' || candidate_id AS value FROM x GROUP BY topic, candidate_id""",
}
