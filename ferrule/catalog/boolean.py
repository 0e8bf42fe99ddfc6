"""Boolean retrieval over the postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.sql import CUR, POST
from ferrule.functions.text import terms
from ferrule.operators import index as ix
from ferrule.plans import boolean as bl
from ferrule.plans.parsers import parse_medline, parse_pubmed
from ferrule.tables import table

TEXTS = {
    "and": "1. thrombosis.ti,ab.\n2. anticoagulation.ti,ab.\n3. 1 and 2",
    "or": "asthma.ti,ab. or wheeze.ti,ab. or insomnia.ti.",
    "not": "1. insomnia.ti,ab.\n2. depression.ti,ab.\n3. 1 not 2",
    "nested": "1. exp Hypertension/\n2. (blood adj2 pressure).ti,ab.\n3. or/1-2\n4. regist$.ti,ab.\n5. children.ab.\n6. (3 and 4) not 5",
    "wildcard": "cardi$.ti,ab. and reg*.ti.",
    "phrase": '"heart failure".ti,ab. or Sepsis/',
}
PUBMED = {"dates": "(malaria[Title/Abstract] OR hepatitis[Title/Abstract]) AND 2015/01:2021/12[Publication Date]"}
TREES = {k: parse_medline(v) for k, v in TEXTS.items()} | {k: parse_pubmed(v) for k, v in PUBMED.items()}


def _hits(name):
    def run(s, d):
        return bl.matching({name: TREES[name]}, ix.delivered_postings(s, d), ix.medline_documents(s, d) if name == "dates" else None)

    return run


def bool_all_topics(s, d):
    return bl.matching(TREES, ix.delivered_postings(s, d), ix.medline_documents(s, d))


def bool_row_wise(s, d):
    return bl.matching_rows(TREES, ix.medline_documents(s, d))


def bool_node_sizes(s, d):
    judged = table(s, d, "term_vectors").select(F.lit("nested").alias("topic"), F.col("pmid").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return bl.node_sizes({"nested": TREES["nested"]}, ix.delivered_postings(s, d), judged)


def retrieval_size(s, d):
    return bool_all_topics(s, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def bool_as_run(s, d):
    return bl.as_run(bl.matching({"or": TREES["or"]}, ix.delivered_postings(s, d)), "boolean")


def set_algebra(s, d):
    """Three clauses of the collection by rank of their hash, combined: first and second, without the third."""
    members = table(s, d, "clause_docs").where("hash IS NOT NULL AND pmid IS NOT NULL")
    sizes = members.groupBy("hash").agg(F.count_distinct("pmid").alias("n")).orderBy(F.col("n").desc(), "hash").limit(3)
    from pyspark.sql import Window

    numbered = sizes.withColumn("set_id", F.row_number().over(Window.orderBy(F.col("n").desc(), "hash")))  # three rows
    sets = members.join(F.broadcast(numbered.select("hash", "set_id")), "hash").select("set_id", F.col("pmid").alias("doc_id"))
    parts = [bl.set_combine(op, sets, m).select(F.lit(name).alias("op"), "doc_id") for name, op, m in (("and", "and", [1, 2]), ("or", "or", [1, 2, 3]), ("not", "not", [1, 2, 3]), ("adj", "adj3", [1, 3]))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bool_adjacent(s, d):
    docs = ix.medline_documents(s, d)
    where = docs.select("doc_id", F.lit("ab").alias("field"), F.posexplode(terms("ab")).alias("i", "term"))
    return bl.adjacent(where, "blood", "pressure", 2)


QUERIES = {f"bool_{k}": _hits(k) for k in TREES} | {f.__name__: f for f in (bool_all_topics, bool_row_wise, bool_node_sizes, retrieval_size, bool_as_run, set_algebra, bool_adjacent)}


def _t(word: str, fields: str = "'ti', 'ab'") -> str:
    test = f"starts_with(term, '{word[:-1]}')" if word.endswith("*") else f"term = '{word}'"
    return f"SELECT doc_id FROM p WHERE field IN ({fields}) AND {test}"


def _both(a: str, b: str) -> str:
    """Two words in the same field."""
    return f"SELECT x.doc_id FROM p x JOIN p y USING (doc_id, field) WHERE x.term = '{a}' AND y.term = '{b}' AND field IN ('ti', 'ab')"


_BASE = f"(({_t('hypertension', chr(39) + 'mh' + chr(39))}) UNION ({_t('blood')} INTERSECT {_t('pressure')}))"
_SETS = {
    "and": f"{_t('thrombosis')} INTERSECT {_t('anticoagulation')}",
    "or": f"{_t('asthma')} UNION {_t('wheeze')} UNION {_t('insomnia', chr(39) + 'ti' + chr(39))}",
    "not": f"{_t('insomnia')} EXCEPT {_t('depression')}",
    "nested": f"({_BASE} INTERSECT ({_t('regist*')})) EXCEPT ({_t('children', chr(39) + 'ab' + chr(39))})",
    "wildcard": f"({_t('cardi*')}) INTERSECT ({_t('reg*', chr(39) + 'ti' + chr(39))})",
    "phrase": f"({_both('heart', 'failure')}) UNION ({_t('sepsis', chr(39) + 'mh' + chr(39))})",
    "dates": f"(({_t('malaria')}) UNION ({_t('hepatitis')})) INTERSECT (SELECT doc_id FROM cur WHERE strftime(dcom, '%Y/%m') BETWEEN '2015/01' AND '2021/12')",
}
_ALL = f"WITH {POST}, {CUR} " + " UNION ALL ".join(f"SELECT '{k}' AS topic, doc_id FROM ({v})" for k, v in _SETS.items())
_NODES = [_SETS["nested"], f"{_BASE} INTERSECT ({_t('regist*')})", _BASE, f"({_t('hypertension', chr(39) + 'mh' + chr(39))}) UNION (SELECT -1 AS doc_id WHERE false)", f"({_t('blood')}) INTERSECT ({_t('pressure')})", f"({_t('blood')}) UNION ({_t('blood')})", f"({_t('pressure')}) UNION ({_t('pressure')})", f"({_t('regist*')}) UNION ({_t('regist*')})", f"({_t('children', chr(39) + 'ab' + chr(39))}) UNION (SELECT -1 AS doc_id WHERE false)"]
_TOP3 = """m AS (SELECT DISTINCT hash, pmid AS doc_id FROM clause_docs WHERE hash IS NOT NULL AND pmid IS NOT NULL),
z AS (SELECT hash, row_number() OVER (ORDER BY count(*) DESC, hash) AS i FROM m GROUP BY hash), s AS (SELECT i, doc_id FROM m JOIN z USING (hash) WHERE i <= 3)"""
ORACLES = {f"bool_{k}": f"WITH {POST}, {CUR} SELECT '{k}' AS topic, doc_id FROM ({v})" for k, v in _SETS.items()} | {
    "bool_all_topics": _ALL,
    "bool_row_wise": _ALL,
    "bool_node_sizes": f"WITH {POST}, {CUR} " + " UNION ALL ".join(f"SELECT 'nested' AS topic, {i} AS node_id, count(*) AS n, count(*) FILTER (doc_id IN (SELECT pmid FROM term_vectors)) AS r FROM ({q})" for i, q in enumerate(_NODES)),
    "retrieval_size": f"SELECT topic, count(*) AS n FROM ({_ALL}) GROUP BY topic",
    "bool_as_run": f"WITH {POST} SELECT 'or' AS topic, 'Q0' AS iteration, CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, 0.0 AS score, 'boolean' AS run_name FROM ({_SETS['or']}) t",
    "set_algebra": f"""WITH {_TOP3}
SELECT 'and' AS op, doc_id FROM (SELECT doc_id FROM s WHERE i = 1 INTERSECT SELECT doc_id FROM s WHERE i = 2)
UNION ALL SELECT 'or', doc_id FROM (SELECT DISTINCT doc_id FROM s)
UNION ALL SELECT 'not', doc_id FROM (SELECT doc_id FROM s WHERE i = 1 EXCEPT SELECT doc_id FROM s WHERE i IN (2, 3))
UNION ALL SELECT 'adj', doc_id FROM (SELECT doc_id FROM s WHERE i = 1 INTERSECT SELECT doc_id FROM s WHERE i = 3)""",
    "bool_adjacent": rf"""WITH {CUR}, w AS (SELECT doc_id, unnest(x) AS term, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(ab), '[\p{{L}}\p{{N}}]+') AS x FROM cur WHERE ab IS NOT NULL))
SELECT DISTINCT a.doc_id FROM w a JOIN w b USING (doc_id) WHERE a.term = 'blood' AND b.term = 'pressure' AND abs(a.i - b.i) <= 2""",
}
