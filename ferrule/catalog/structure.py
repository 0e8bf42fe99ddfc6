"""Structure of the collection's query clauses: parsed where they lie, measured as rows of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.catalog.evaluation import _r
from ferrule.operators import index as ix
from ferrule.operators import structure as st
from ferrule.plans.rewrites import REWRITES
from ferrule.plans.variations import TRANSFORMERS, Candidate, variations
from ferrule.sources.readers import parse_column
from ferrule.tables import table


def clauses(s, d):
    """(hash, query): every clause once."""
    return table(s, d, "clauses").where("hash IS NOT NULL AND query IS NOT NULL").groupBy("hash").agg(F.min("query").alias("query"))


def _nodes(s, d):
    return st.nodes(clauses(s, d), "hash", "query", "expression")


def clause_nodes(s, d):
    """The nodes of every clause in pre-order; -1 stands for no parent or top, false for options that are not given."""
    number, flag = ({c: F.coalesce(c, F.lit(v)) for c in names} for names, v in ((("parent_id", "top"), -1), (("exploded", "truncated"), False)))
    return _nodes(s, d).withColumns({"fields": F.array_join("fields", ","), **number, **flag})


def structure_counts(s, d):
    return st.counts(_nodes(s, d), "hash").select("hash", "keywords", "boolean_nodes", "and_clauses", "or_clauses", "not_clauses", "adj_clauses", "truncated", "terms", "mesh_exploded")


def structure_counts_compat(s, d):
    return st.counts(_nodes(s, d), "hash", compat=True).select("hash", "boolean_nodes")


def structure_fields(s, d):
    return st.counts(_nodes(s, d), "hash").select("hash", "fields", "fields_title", "fields_abstract", "fields_mesh", "fields_other")


def query_complexity(s, d):
    return _r(st.complexity(_nodes(s, d), "hash"), "complexity")


def measurements_long(s, d):
    return st.measured(st.counts(_nodes(s, d), "hash"), ["keywords", "terms", "truncated"], "hash")


def mesh_explosion_ratio(s, d):
    return _r(st.explosion_ratio(st.counts(_nodes(s, d), "hash"), "hash").select("hash", "ratio"), "ratio")


def mesh_tree_depths(s, d):
    """Depth of headings in a tree made of the collection's headings: their words as levels."""
    heads = ix.medline_documents(s, d).select(F.explode("mh").alias("heading")).where("heading IS NOT NULL").select(F.lower("heading").alias("heading")).distinct()
    tree = heads.select("heading", F.translate("heading", " ", ".").alias("tree_number"))
    return _r(st.mesh_depths(_nodes(s, d), tree, "hash"), "avg_depth")


def string_reachability(s, d):
    """Keywords of each clause within the first document, by number, whose topic the clause has; ti and ab stand for the protocol's sections."""
    topics = table(s, d, "clauses").where("hash IS NOT NULL AND topic IS NOT NULL").select("hash", "topic").distinct()
    docs = table(s, d, "documents").where("topic IS NOT NULL AND text IS NOT NULL").groupBy(F.trim("topic").alias("topic")).agg(F.min(F.struct("doc_id", "text")).alias("r")).select("topic", F.col("r.text").alias("objective"))
    per = _nodes(s, d).where("kind = 'kw'").join(topics, "hash")
    return st.string_reachability(per, docs, ["objective"], "topic")


def concept_reachability(s, d):
    """Headings of a clause against headings of the documents, by the first letter as the section."""
    nodes = _nodes(s, d).where("kind = 'kw' AND array_contains(fields, 'mesh_headings')").select(F.lit("all").alias("topic"), F.lower("query_string").alias("cui"))
    mh = ix.medline_documents(s, d).select(F.explode("mh").alias("h")).where("h IS NOT NULL AND trim(h) <> ''").select(F.lit("all").alias("topic"), F.lower(F.trim("h")).alias("cui")).withColumn("section", F.substring("cui", 1, 1))
    return _r(st.concept_reachability(nodes, mh), "ratio")


def concept_score_distribution(s, d):
    """(side, i, score): the i-th smallest number of occurrences of the headings that some clause has (``inside``), and of the others."""
    both = st.concept_score_distributions(
        ix.delivered_postings(s, d).where("field = 'mh'").groupBy(F.lit("all").alias("topic"), F.col("term").alias("cui")).agg((-F.sum("tf")).alias("score")),
        _nodes(s, d).where("kind = 'kw' AND array_contains(fields, 'mesh_headings')").select(F.lit("all").alias("topic"), F.lower("query_string").alias("cui")),
    )
    sides = F.inline(F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("scores")) for n in ("inside", "outside")]))
    return both.select(sides).select("side", F.posexplode("scores").alias("i", "score"))


def _rewritten(name):
    """(hash, query): every clause after one rewrite, as printed; null where nothing is left of it."""

    def run(s, d):
        from ferrule.plans.ast import from_json

        fn = REWRITES[name]

        def go(batches):
            for pdf in batches:
                out = [None if q is None or (new := fn(from_json(q))) is None else str(new) for q in pdf["query"]]
                yield pdf[["hash"]].assign(query=out)

        return parse_column(clauses(s, d), "hash", "query").select("hash", "query").mapInPandas(go, "hash long, query string")

    return run


def clause_variations(s, d):
    """(hash, transformation_id, n): the single edits of every clause, by transformation."""
    import pandas as pd

    from ferrule.plans.ast import from_json

    def go(batches):
        for pdf in batches:
            rows = []
            for h, q in zip(pdf["hash"], pdf["query"]):
                if q is not None:
                    rows += [(h, v.transformation) for v in variations(Candidate(from_json(q), -1), TRANSFORMERS)]
            yield pd.DataFrame(rows, columns=["hash", "transformation_id"]).astype({"hash": "int64", "transformation_id": "int32"})

    parsed = parse_column(clauses(s, d), "hash", "query").select("hash", "query")
    return parsed.mapInPandas(go, "hash long, transformation_id int").groupBy("hash", "transformation_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    clause_nodes, structure_counts, structure_counts_compat, structure_fields, query_complexity, measurements_long, mesh_explosion_ratio, mesh_tree_depths, string_reachability, concept_reachability, concept_score_distribution, clause_variations,
)} | {f"rewrite_{n}": _rewritten(n) for n in REWRITES}

_C = "c AS (SELECT hash, min(query) AS query, lower(min(query)) AS l FROM clauses WHERE hash IS NOT NULL AND query IS NOT NULL GROUP BY hash)"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(l, '{pattern}'))"


_AND, _OR, _NOT, _ADJ = _n(" and "), _n(" or "), _n(" not "), _n(r" adj\d* ")
_OPS = f"({_AND} + {_OR} + {_NOT} + {_ADJ})"
_WORDS = r"""len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '\[[^\]]*\]', ' ', 'g'), '\.[a-z]{2}(,[a-z]{2})*\.', ' ', 'g'), ' (and|or|not|adj\d*) ', ' ', 'g'), 'exp ', ' ', 'g'), '[^\s()]+'))"""
#: Groups of two equal keywords: leaving out either one gives the same query.
_TWINS = r"len(list_filter(list_zip(regexp_extract_all(l, '\(([^()]+) (?:and|or|not|adj\d*) ([^()]+)\)', 1), regexp_extract_all(l, '\(([^()]+) (?:and|or|not|adj\d*) ([^()]+)\)', 2)), lambda x: x[1] = x[2]))"
_MESH = f"({_n('exp ')} + {_n('.mesh terms.')})"
_BOTH = f"({_n('.title/abstract.')} + {_n('.tiab.')} + {_n(r'[.]ti,ab[.]')} + {_n(r'[.]tw[.]')} + {_n(r'[.]mp[.]')})"
_TITLE = f"({_n(r'[[]title[]]')} + {_BOTH})"
_ABS = _BOTH
_MF = f"({_MESH} + {_n(r'[.]mp[.]')})"
_ALLF = f"{_n(r'[[]all fields[]]')}"
def _printed() -> str:
    """k: the clauses as printed, each keyword's text between the marks chr(1) and chr(2). The clauses are in brackets throughout, so that their printed form is a matter of replacement."""
    fields = [("(title/abstract|tiab)", "[title,abstract]"), ("title", "[title]"), ("all fields", "[all_fields]"), ("mesh terms", "+[mesh_headings]")]
    ends = [("(tw|ti,ab)", "[title,abstract]"), ("mp", "[title,abstract,mesh_headings]")]
    marked = r"""regexp_replace(query, 'exp ([^/]+)/', chr(1) || '\1' || chr(2) || '+[mesh_headings]', 'g')"""
    for mark, names in ((r"\[{}\]", fields), (r"\.{}\.", ends)):
        for name, out in names:
            end = mark.format(name)
            marked = rf"""regexp_replace({marked}, '(?i)"([^"]+)"(\*?){end}', chr(1) || '\1' || chr(2) || '{"+" * out.startswith("+")}\2{out.lstrip("+")}', 'g')"""
            marked = rf"""regexp_replace({marked}, '(?i)([^\s()"\[\].*\x01\x02][^\s()"\[\].\x01\x02]*){end}', chr(1) || '\1' || chr(2) || '{out}', 'g')"""
    for op in ("and", "or", "not"):
        marked = f"regexp_replace({marked}, '(?i) {op} ', ' {op} ', 'g')"
    marked = rf"regexp_replace({marked}, '(?i) adj(\d*) ', ' adj\1 ', 'g')"
    return f"{_C}, k AS (SELECT hash, {marked} AS q FROM c)"


def _repeated(text: str, times: int, *steps: tuple[str, str]) -> str:
    for _ in range(times):
        for pattern, by in steps:
            text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


def _rewrite_sql() -> dict[str, str]:
    """The texts of the rewritten clauses. Filters are printed in full here, apart from the code that builds them."""
    rct = "(Randomized Controlled Trials As Topic+[mesh_headings] or Randomized Controlled Trial[publication_type] or Controlled Clinical Trial[publication_type] or randomized[text_word] or placebo[text_word] or randomly[text_word] or trial[title])"
    trials = "randomized controlled trial[publication_type] or controlled clinical trial[publication_type] or randomized[title,abstract] or placebo[title,abstract]"
    sensitive = f"(({trials} or drug therapy[mesh_floating] or randomly[title,abstract] or trial[title,abstract] or groups[title,abstract]) not (animals[mesh_headings] not humans[mesh_headings]))"
    precise = f"(({trials} or clinical trials as topic[mesh_headings] or randomly[title,abstract] or trial[title]) not (animals[mesh_headings] not humans[mesh_headings]))"
    ops = r" (and|or|not|adj\d*) "
    word = r"\x01[^\x02]*\x02[^ ()]*"
    gone = r"""regexp_replace(q, '\x01[^\x02]*\x02[+]?[*]?\[mesh_headings\]', chr(3), 'g')"""
    merged = _repeated("q", 4, *((rf" {op} ({word})\) {op} ", rf"' {op} \1 {op} '") for op in ("and", "or")))
    flat = f"substr({merged}, 1 + length(q) - length({merged}))"  # groups nest to the left: for every inner bracket that goes, one of those at the front goes
    parts = r"""array_to_string(list_transform(string_split(q, chr(1)), lambda x: CASE WHEN contains(x, chr(2)) AND contains(split_part(x, chr(2), 1), ' ') AND NOT starts_with(ltrim(split_part(x, chr(2), 2), '+*'), '[mesh')
  THEN '(' || array_to_string(list_transform(string_split(split_part(x, chr(2), 1), ' '), lambda w: w || regexp_extract(ltrim(split_part(x, chr(2), 2), '*'), '^[^ ()]*')), ' or ') || ')' || regexp_replace(split_part(x, chr(2), 2), '^[^ ()]*', '') ELSE x END), '')"""
    texts = {
        "all_and": f"regexp_replace(q, '{ops}', ' and ', 'g')", "all_or": f"regexp_replace(q, '{ops}', ' or ', 'g')", "simplify_operators": r"regexp_replace(q, ' (or|not|adj\d*) ', ' or ', 'g')", "no_explosion": "replace(q, chr(2) || '+', chr(2))",
        "rct_filter": f"CASE WHEN starts_with(q, '(') THEN '(' || q || ' and {rct})' ELSE q END", "sensitivity_filter": f"'(' || q || ' and {sensitive})'", "precision_sensitivity_filter": f"'(' || q || ' and {precise})'",
        "remove_mesh": f"nullif({_repeated(gone, 5, (rf'\x03{ops}', repr('')), (rf'{ops}\x03', repr('')), (r'\(\x03\)', 'chr(3)'))}, chr(3))", "flatten": flat, "relax_phrases": parts,
    }
    return {f"rewrite_{n}": f"WITH {_printed()} SELECT hash, translate({text}, chr(1) || chr(2), '') AS query FROM k" for n, text in texts.items()}


def _keyword_sql() -> dict[str, str]:
    """Queries over the keywords of the printed clauses. Groups nest to the left, so a clause of n operators has its n groups first, from the outermost, and then its keywords in order."""
    words = rf"""{_printed()}, w AS (SELECT hash, i, n, split_part(substr(x, 2), chr(2), 1) AS text, regexp_extract(x, '\[([^\]]*)\]', 1) AS fields, contains(x, chr(2) || '+') AS plus, contains(x, chr(2) || '*') OR contains(x, '+*') OR contains(x, '*' || chr(2)) AS cut
  FROM (SELECT hash, unnest(l) AS x, unnest(range(len(l))) AS i, len(l) - 1 AS n FROM (SELECT hash, regexp_extract_all(q, '\x01[^\x02]*\x02[^ ()]*') AS l FROM k)))"""
    ops = r"""o AS (SELECT hash, unnest(l) AS operator, len(l) - unnest(range(len(l))) - 1 AS node_id, len(l) AS n FROM (SELECT hash, list_transform(regexp_extract_all(q, ' (?:and|or|not|adj\d*) '), lambda x: trim(x)) AS l FROM k) WHERE len(l) > 0)"""
    post = """p AS (SELECT term, pmid AS doc_id, max(tf) AS tf FROM postings WHERE term IS NOT NULL AND pmid IS NOT NULL AND field = 'mh' GROUP BY ALL)"""
    cur = "cur AS (SELECT mh FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY loaded_at DESC NULLS LAST, ti DESC NULLS LAST, ab DESC NULLS LAST, mh DESC NULLS LAST, dcom DESC NULLS LAST) AS r FROM medline WHERE pmid IS NOT NULL) WHERE r = 1)"
    mesh = "contains(fields, 'mesh_headings')"
    return {
        "clause_nodes": f"""WITH {words}, {ops}
SELECT hash, CAST(node_id AS INTEGER) AS node_id, CAST(CASE WHEN node_id > 0 THEN node_id - 1 ELSE -1 END AS INTEGER) AS parent_id, 0 AS ord, CAST(node_id AS INTEGER) AS depth, 'bool' AS kind, operator, NULL AS query_string, NULL AS fields, false AS exploded,
       false AS truncated, CASE WHEN node_id > 0 THEN 1 ELSE -1 END AS top FROM o
UNION ALL SELECT hash, n + i, CASE WHEN n > 0 THEN n - greatest(i, 1) ELSE -1 END, CASE WHEN i > 0 THEN 1 ELSE 0 END, CASE WHEN n > 0 THEN n + 1 - greatest(i, 1) ELSE 0 END, 'kw', NULL, text, fields, plus, cut,
       CASE WHEN n = 0 THEN -1 WHEN i = n THEN 2 * n ELSE 1 END FROM w""",
        "mesh_tree_depths": f"""WITH {words}, {cur}, t AS (SELECT h, min(len(string_split(replace(h, ' ', '.'), '.'))) AS d FROM (SELECT DISTINCT lower(unnest(mh)) AS h FROM cur) WHERE h IS NOT NULL GROUP BY h)
SELECT k.hash, round(coalesce(avg(d), 0), 6) AS avg_depth, coalesce(max(d), 0) AS max_depth FROM k LEFT JOIN (SELECT hash, d FROM w JOIN t ON h = lower(replace(text, '*', '')) WHERE {mesh}) USING (hash) GROUP BY k.hash""",
        "string_reachability": f"""WITH {words}, t AS (SELECT DISTINCT hash, topic FROM clauses WHERE hash IS NOT NULL AND topic IS NOT NULL),
dd AS (SELECT trim(topic) AS topic, arg_min(text, doc_id) AS text FROM documents WHERE topic IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
SELECT topic, count(*) AS keywords, count(*) FILTER (x <> '' AND contains(lower(text_), x)) AS n_objective FROM (
  SELECT topic, lower(replace(w.text, '*', '')) AS x, dd.text AS text_ FROM w JOIN t USING (hash) JOIN dd USING (topic)) GROUP BY topic""",
        "concept_reachability": f"""WITH {words}, {cur}, q AS (SELECT DISTINCT lower(text) AS cui FROM w WHERE {mesh}),
m AS (SELECT DISTINCT lower(trim(h)) AS cui FROM (SELECT unnest(mh) AS h FROM cur) WHERE h IS NOT NULL AND trim(h) <> '')
SELECT 'all' AS topic, section, shared, n + (SELECT count(*) FROM q) - shared AS either, round(shared / (n + (SELECT count(*) FROM q) - shared), 6) AS ratio
FROM (SELECT left(cui, 1) AS section, count(*) AS n, count(*) FILTER (cui IN (SELECT cui FROM q)) AS shared FROM m GROUP BY 1) WHERE (SELECT count(*) FROM q) > 0""",
        "concept_score_distribution": f"""WITH {words}, {post}, q AS (SELECT DISTINCT lower(text) AS cui FROM w WHERE {mesh}), s AS (SELECT term, sum(tf) AS score, term IN (SELECT cui FROM q) AS inq FROM p GROUP BY term)
SELECT CASE WHEN inq THEN 'inside' ELSE 'outside' END AS side, CAST(row_number() OVER (PARTITION BY inq ORDER BY score) - 1 AS INTEGER) AS i, score FROM s""",
    }


ORACLES = {
    "structure_counts": f"WITH {_C} SELECT hash, 1 + {_OPS} AS keywords, {_OPS} AS boolean_nodes, {_AND} + {_ADJ} AS and_clauses, {_OR} AS or_clauses, {_NOT} AS not_clauses, {_ADJ} AS adj_clauses, {_n('[*]')} AS truncated, {_WORDS} AS terms, {_MESH} AS mesh_exploded FROM c",
    "structure_counts_compat": f"WITH {_C} SELECT hash, 2 * {_OPS} - 1 AS boolean_nodes FROM c",
    "structure_fields": f"WITH {_C} SELECT hash, {_TITLE} + {_ABS} + {_MF} + {_ALLF} AS fields, {_TITLE} AS fields_title, {_ABS} AS fields_abstract, {_MF} AS fields_mesh, {_ALLF} AS fields_other FROM c",
    "query_complexity": f"WITH {_C} SELECT hash, round(CASE WHEN {_OPS} = 0 THEN 0 ELSE ({_OPS} - 1) / (1 + {_OPS}) / 2 * (2 * {_OPS}) END, 6) AS complexity FROM c",
    "measurements_long": f"WITH {_C} SELECT hash, 'keywords' AS name, CAST(1 + {_OPS} AS DOUBLE) AS value FROM c UNION ALL SELECT hash, 'terms', CAST({_WORDS} AS DOUBLE) FROM c UNION ALL SELECT hash, 'truncated', CAST({_n('[*]')} AS DOUBLE) FROM c",
    "mesh_explosion_ratio": f"WITH {_C} SELECT hash, round(CASE WHEN {_MF} > 0 THEN {_MESH} / {_MF} ELSE 0 END, 6) AS ratio FROM c",
    "clause_variations": f"""WITH {_C}, v AS (SELECT hash, 0 AS transformation_id, {_AND} + {_OR} AS n FROM c UNION ALL SELECT hash, 1, 2 * {_ADJ} FROM c UNION ALL SELECT hash, 2, {_MESH} FROM c
UNION ALL SELECT hash, 3, 2 * {_TITLE} FROM c UNION ALL SELECT hash, 4, {_ADJ} FROM c UNION ALL SELECT hash, 5, 2 * {_OPS} - {_TWINS} FROM c) SELECT * FROM v WHERE n > 0""",
} | _rewrite_sql() | _keyword_sql()
