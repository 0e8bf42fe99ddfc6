"""Shared parts of the SQL texts."""

CUR = """cur AS (SELECT pmid AS doc_id, ti, ab, mh, CAST(try_strptime(dcom, '%Y%m%d') AS DATE) AS dcom FROM (
  SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY loaded_at DESC NULLS LAST, ti DESC NULLS LAST, ab DESC NULLS LAST, mh DESC NULLS LAST, dcom DESC NULLS LAST) AS r
  FROM medline WHERE pmid IS NOT NULL) WHERE r = 1)"""

POST = """p AS (SELECT term, field, pmid AS doc_id, max(tf) AS tf, max(pos) AS pos FROM postings
  WHERE term IS NOT NULL AND pmid IS NOT NULL AND field IS NOT NULL GROUP BY ALL)"""

RUN = """r AS (SELECT topic, run_name, doc_id, score, row_number() OVER (PARTITION BY topic, run_name ORDER BY score DESC, doc_id) AS rn FROM (
  SELECT topic, run_name, try_cast(trim(doc_id) AS BIGINT) AS doc_id, max(score) AS score FROM runs
  WHERE topic IS NOT NULL AND try_cast(trim(doc_id) AS BIGINT) IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))"""

QRELS = "q AS (SELECT DISTINCT topic, doc_id, doc_id % 3 AS grade FROM r WHERE rn <= 50)"


def words(topics: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{t}', '{w}')" for t, ws in topics.items() for w in ws)
    return f"w AS (SELECT * FROM (VALUES {rows}) AS v(topic, term))"


def rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


def tree_sql(node) -> str:
    """The documents of a query tree as set algebra over ``p``: a keyword is the union over its fields of the intersection over its words."""
    from ferrule.plans.ast import Keyword

    if isinstance(node, Keyword):
        fields = {"title": ["ti"], "abstract": ["ab"], "mesh_headings": ["mh"], "text_word": ["ti", "ab"], "all_fields": ["ti", "ab", "mh"]}
        parts = []
        for field in dict.fromkeys(f for name in node.fields for f in fields[name]):
            words = [node.text.lower()] if field == "mh" else node.text.lower().split()
            parts.append(" INTERSECT ".join(f"SELECT doc_id FROM p WHERE field = '{field}' AND " + (f"starts_with(term, '{w[:-1]}')" if w.endswith("*") else f"term = '{w}'") for w in words))
        return " UNION ".join(f"SELECT doc_id FROM ({part})" for part in parts)
    first, *rest = [f"SELECT doc_id FROM ({tree_sql(c)})" for c in node.children]
    if node.operator == "not":
        return f"{first} EXCEPT SELECT doc_id FROM ({' UNION '.join(rest)})" if rest else first
    return (" UNION " if node.operator == "or" else " INTERSECT ").join([first, *rest])


def number(x: str) -> str:
    """A double as Spark prints it: below a thousandth with an exponent, NaN in capitals."""
    text = f"CAST({x} AS VARCHAR)"
    digits = rf"regexp_extract({text}, '^(-?)0\.(0*)([1-9])(\d*)$', {{}})"
    plain = f"{digits.format(1)} || {digits.format(3)} || '.' || CASE WHEN {digits.format(4)} = '' THEN '0' ELSE {digits.format(4)} END || 'E-' || (length({digits.format(2)}) + 1)"
    short = f"split_part({text}, 'e', 1) || CASE WHEN contains(split_part({text}, 'e', 1), '.') THEN '' ELSE '.0' END || 'E' || CAST(split_part({text}, 'e', 2) AS INTEGER)"
    return f"CASE WHEN isnan({x}) THEN 'NaN' WHEN {x} = 0 OR abs({x}) >= 0.001 THEN {text} WHEN contains({text}, 'e') THEN {short} ELSE {plain} END"
