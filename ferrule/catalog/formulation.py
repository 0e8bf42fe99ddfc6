"""Formulating queries: term selection, splits, information gain, headings, coverage, embeddings. A topic's relevant documents are those with its heading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.evaluation import _r
from ferrule.catalog.saved import postings
from ferrule.catalog.sql import CUR, POST
from ferrule.operators import formulation as fo
from ferrule.operators import index as ix
from ferrule.plans.ast import to_json
from ferrule.tables import table, written

HEADINGS = ["hypertension", "anxiety", "sepsis"]


def _judged(s, d):
    rows = postings(s, d).where(F.col("field").eqNullSafe("mh") & F.col("term").isin(HEADINGS))
    return rows.select(F.col("term").alias("topic"), "doc_id").distinct()


def _terms(s, d):
    return postings(s, d).where("field IN ('ti', 'ab')").select("doc_id", "term").distinct()


def _dev(s, d):
    return fo.split(_judged(s, d)).where("part = 'dev'")


def _freq(s, d):
    return fo.document_frequencies(_dev(s, d).join(_terms(s, d), "doc_id").select("topic", "doc_id", "term"))


def _sizes(s, d):
    return _dev(s, d).groupBy("topic").agg(F.count(F.lit(1)).alias("size"))


def split_50_25_25(s, d):
    return fo.split(_judged(s, d))


def term_doc_freq(s, d):
    return _freq(s, d)


def cut_dev_terms(s, d):
    return fo.cut_development(_freq(s, d), _sizes(s, d), 0.25)


def cut_population(s, d):
    t = _terms(s, d)
    return fo.cut_population(_freq(s, d), t.groupBy("term").agg(F.count_distinct("doc_id").alias("pop_df")), t.agg(F.count_distinct("doc_id").alias("pop_size")), 0.1)


def ranked_terms(s, d):
    return _r(fo.rank_terms(_freq(s, d), _sizes(s, d)), "share")


def _labels(s, d):
    docs = ix.medline_documents(s, d).select("doc_id")
    pos = _judged(s, d).where("topic = 'hypertension'").select("doc_id", F.lit(True).alias("y"))
    return docs.join(pos, "doc_id", "left").select("doc_id", F.coalesce("y", F.lit(False)).alias("label"))


def info_gain(s, d):
    return _r(fo.information_gain(_terms(s, d), _labels(s, d)), "gain")


def id3_query(s, d):
    """The query that a decision tree over the terms of titles and abstracts gives for the heading hypertension."""
    query = fo.tree_query(fo.id3(_terms(s, d), _labels(s, d)))
    return s.createDataFrame([(None if query is None else to_json(query),)], "query string")


def _objective(s, d):
    """The keywords of the formulated queries, per heading: ``terms``, and ``headings`` for the terms with headings."""
    held, docs, terms, judged = postings(s, d), written(ix.medline_documents(s, d).select("doc_id", "mh")), written(_terms(s, d)), written(_judged(s, d))
    made = {}
    for h in HEADINGS:
        found = fo.ObjectiveFormulator().choose(s, judged.where(F.col("topic") == h), docs, terms, held)
        made |= {f"{h}/{how}": groups for how, groups in zip(("terms", "headings"), found) if groups}
    return judged, held, made


def objective_query(s, d):
    """(topic, doc_id, query): the documents of the formulated queries."""
    _, held, made = _objective(s, d)
    hits, name = fo.category_hits(made, held), F.split("topic", "/")
    return hits.select(name[0].alias("topic"), "doc_id", name[1].alias("query"))


def objective_evaluation(s, d):
    """(topic, part, query, name, value): the formulated queries on the development, validation and unseen documents."""
    judged, held, made = _objective(s, d)
    out = None
    for h in HEADINGS:
        mine = {k.split("/")[1]: q for k, q in made.items() if k.startswith(f"{h}/")}
        if mine:
            per = fo.objective_measures(fo.split(judged.where(F.col("topic") == h)), mine, held).select(F.lit(h).alias("topic"), "part", "query", "name", F.round("value", 6).alias("value"))
            out = per if out is None else out.unionByName(per)
    return out if out is not None else s.createDataFrame([], "topic string, part string, query string, name string, value double")


def top_mesh(s, d):
    docs = ix.medline_documents(s, d)
    return fo.top_headings(_judged(s, d).join(docs.select("doc_id", "mh"), "doc_id"), 5, ["humans", "male", "female", "adult", "aged", "child"])


def unique_coverage_terms(s, d):
    """Terms of two categories, the first half of the alphabet and the second, within titles of the collection."""
    t = postings(s, d).where("field = 'ti'").select(F.when(F.col("term") < "m", "a").otherwise("b").alias("category"), "term", "doc_id")
    return fo.unique_coverage(t)


def embedding_knn(s, d):
    v = table(s, d, "embeddings")
    return _r(fo.nearest_vectors(v.where("vec_id % 20 = 0"), v, 10), "similarity")


def embedding_centroid(s, d):
    c = fo.centroids(table(s, d, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "v")).select("label", "i", F.round("v", 5).alias("v"))


def relevance_feedback(s, d):
    v = table(s, d, "embeddings")
    return _r(fo.relevance_feedback(v.select(F.col("label").alias("clause_id"), "embedding"), v.select(F.col("vec_id").cast("string").alias("term"), "embedding")), "similarity")


QUERIES = {f.__name__: f for f in (
    split_50_25_25, term_doc_freq, cut_dev_terms, cut_population, ranked_terms, info_gain, id3_query, objective_query, objective_evaluation, top_mesh, unique_coverage_terms, embedding_knn, embedding_centroid, relevance_feedback,
)}
_J = f"""{POST}, j AS (SELECT DISTINCT term AS topic, doc_id FROM p WHERE field = 'mh' AND term IN ('hypertension', 'anxiety', 'sepsis')),
i AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ((doc_id % 1000003) * 7919 + 1000 * 104729) % 1000003, doc_id) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n FROM j),
sp AS (SELECT topic, doc_id, CASE WHEN i < floor(n / 2) THEN 'dev' WHEN i < floor(n * 3 / 4) THEN 'val' ELSE 'unseen' END AS part FROM i),
t AS (SELECT DISTINCT doc_id, term FROM p WHERE field IN ('ti', 'ab')), f AS (SELECT topic, term, count(DISTINCT doc_id) AS df FROM sp JOIN t USING (doc_id) WHERE part = 'dev' GROUP BY ALL),
sz AS (SELECT topic, count(*) AS size FROM sp WHERE part = 'dev' GROUP BY topic)"""


def _h(p: str) -> str:
    return f"CASE WHEN ({p}) > 0 AND ({p}) < 1 THEN -(({p}) * log2({p}) + (1 - ({p})) * log2(1 - ({p}))) ELSE 0 END"


ORACLES = {
    "split_50_25_25": f"WITH {_J} SELECT topic, doc_id, part FROM sp",
    "term_doc_freq": f"WITH {_J} SELECT * FROM f",
    "cut_dev_terms": f"WITH {_J} SELECT topic, term, df FROM f JOIN sz USING (topic) WHERE df >= 0.25 * size",
    "cut_population": f"WITH {_J}, o AS (SELECT term, count(DISTINCT doc_id) AS pop_df FROM t GROUP BY term) SELECT topic, term, df, pop_df FROM f JOIN o USING (term) WHERE pop_df <= 0.1 * (SELECT count(DISTINCT doc_id) FROM t)",
    "ranked_terms": f"WITH {_J} SELECT topic, term, df, round(df / size, 6) AS share, CAST(row_number() OVER (PARTITION BY topic ORDER BY df DESC, term) AS INTEGER) AS position FROM f JOIN sz USING (topic)",
    "info_gain": f"""WITH {_J}, {CUR}, l AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM j WHERE topic = 'hypertension') AS label FROM cur),
x AS (SELECT term, count(*) AS w, count(*) FILTER (label) AS q, (SELECT count(*) FROM l) AS n, (SELECT count(*) FILTER (label) FROM l) AS pos FROM t JOIN l USING (doc_id) GROUP BY term),
y AS (SELECT *, pos / n AS a, q / w AS b, CASE WHEN n > w THEN (pos - q) / (n - w) ELSE 0 END AS c FROM x)
SELECT term, w AS n_with, q AS pos_with, round(({_h('a')}) - w / n * ({_h('b')}) - (n - w) / n * ({_h('c')}), 6) + 0.0 AS gain FROM y""",
    "top_mesh": f"""WITH {_J}, {CUR}, h AS (SELECT DISTINCT topic, doc_id, lower(trim(h)) AS heading FROM (SELECT topic, doc_id, unnest(mh) AS h FROM j JOIN cur USING (doc_id)) WHERE h IS NOT NULL AND trim(h) <> '')
SELECT topic, heading, df FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY df DESC, heading) AS i FROM (
  SELECT topic, heading, count(*) AS df FROM h WHERE heading NOT IN ('humans', 'male', 'female', 'adult', 'aged', 'child') GROUP BY ALL)) WHERE i <= 5""",
    "unique_coverage_terms": f"""WITH {POST}, x AS (SELECT DISTINCT CASE WHEN term < 'm' THEN 'a' ELSE 'b' END AS category, term, doc_id FROM p WHERE field = 'ti'),
jn AS (SELECT doc_id FROM x GROUP BY doc_id HAVING count(DISTINCT category) = 2), u AS (SELECT category, min(term) AS term FROM x WHERE doc_id IN (SELECT doc_id FROM jn) GROUP BY category, doc_id HAVING count(*) = 1)
SELECT category, term, coalesce(k, 0) AS unique_docs FROM (SELECT DISTINCT category, term FROM x) LEFT JOIN (SELECT category, term, count(*) AS k FROM u GROUP BY ALL) USING (category, term)""",
    "embedding_knn": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS i FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE i <= 10""",
    "embedding_centroid": "SELECT label, i, round(avg(CAST(v AS DOUBLE)), 5) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i",
    "relevance_feedback": """WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT CAST(vec_id AS VARCHAR) AS term, label AS clause_id, round(s, 6) AS similarity FROM (SELECT vec_id, c.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s,
row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) DESC, c.label) AS k FROM embeddings CROSS JOIN c) WHERE k = 1""",
}
