"""Query trees to DataFrames of matching documents: set-wise over postings, or row-wise over documents."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import terms
from ferrule.plans.ast import ABSTRACT, ALL, DATE, MESH_FIELDS, PUBLICATION_TYPE, TEXT, TITLE, Boolean, Keyword, Node, keywords, walk

INDEX_FIELDS = {TITLE: ("ti",), ABSTRACT: ("ab",), TEXT: ("ti", "ab"), ALL: ("ti", "ab", "mh"), PUBLICATION_TYPE: (), DATE: (), **{f: ("mh",) for f in MESH_FIELDS}}


def index_fields(keyword: Keyword) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f for name in keyword.fields for f in INDEX_FIELDS.get(name, ())))


def _words(keyword: Keyword, field: str) -> list[tuple[str, bool]]:
    """(word, is prefix) that a field must hold: the whole heading for mh, else every word of the keyword."""
    text = keyword.text.lower().replace('"', "").strip()
    if field == "mh":
        return [(text.rstrip("*"), text.endswith("*"))]
    return [(w.rstrip("*"), w.endswith("*")) for w in text.replace("-", " ").split() if w.rstrip("*")]


def combine(operator: str, parts: list[Column]) -> Column:
    """and, adj: all; not: the first without any of the others; else (or, unknown): any. Nothing combines to false."""
    if not parts:
        return F.lit(False)
    if operator == "and" or operator.startswith("adj"):
        return reduce(lambda a, b: a & b, parts)
    if operator == "not":
        return parts[0] & ~reduce(lambda a, b: a | b, parts[1:]) if len(parts) > 1 else parts[0]
    return reduce(lambda a, b: a | b, parts)


def _evaluate(node: Node, leaf: Mapping[str, Column]) -> Column:
    if isinstance(node, Keyword):
        return leaf[str(node)]
    return combine(node.operator.lower(), [_evaluate(c, leaf) for c in node.children])


class Leaves:
    """The conditions on postings that the keywords of some trees need, each kept once.

    Equal keywords share their flags. A heading with ``exploded`` also takes the narrower headings that ``narrower`` names.
    """

    def __init__(self, roots: list[Node], narrower: Mapping[str, list[str]] | None = None):
        self.narrower = narrower or {}
        self.keywords = {str(k): k for root in roots for k in keywords(root)}
        self.conditions: dict[tuple[str, str, bool], str] = {}
        for k in self.keywords.values():
            for group in self._groups(k):
                for c in group:
                    self.conditions.setdefault(c, f"c{len(self.conditions)}")

    def _groups(self, k: Keyword) -> list[list[tuple[str, str, bool]]]:
        out = []
        for f in index_fields(k):
            words = _words(k, f)
            if words:
                out.append([(f, w, p) for w, p in words])
            if f == "mh" and k.exploded:
                out += [[(f, n.lower(), False)] for n in self.narrower.get(words[0][0], [])]
        return out

    def wanted(self) -> Column:
        """The postings that any condition takes, as a predicate the scan can use."""
        exact = sorted({w for _, w, p in self.conditions if not p})
        prefixes = sorted({w for _, w, p in self.conditions if p})
        parts = ([F.col("term").isin(exact)] if exact else []) + [F.col("term").startswith(w) for w in prefixes]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    def flags(self) -> list[Column]:
        return [
            F.max((F.col("field") == f) & (F.col("term").startswith(w) if p else F.col("term") == w)).alias(name)
            for (f, w, p), name in self.conditions.items()
        ]

    def columns(self) -> dict[str, Column]:
        out = {}
        for name, k in self.keywords.items():
            alternatives = [reduce(lambda a, b: a & b, [F.col(self.conditions[c]) for c in group]) for group in self._groups(k)]
            out[name] = reduce(lambda a, b: a | b, alternatives) if alternatives else F.lit(False)
        return out


def _dates(node: Node) -> list[Keyword]:
    return [k for k in keywords(node) if k.fields == (DATE,)]


def matching(queries: Mapping[str, Node], postings: DataFrame, docs: DataFrame | None = None, narrower: Mapping[str, list[str]] | None = None, nodes: bool = False) -> DataFrame:
    """(topic, doc_id), or with ``nodes`` (topic, node_id, doc_id) for every node in pre-order.

    One scan of the postings that any keyword wants and one aggregation by document evaluate all trees of all topics. A document
    without any flag cannot match, because a complement is always relative. Date ranges need ``docs`` (doc_id, dcom).
    """
    leaves = Leaves(list(queries.values()), narrower)
    if not leaves.conditions:
        return postings.sparkSession.createDataFrame([], "topic string, doc_id long")
    flagged = postings.where(leaves.wanted()).groupBy("doc_id").agg(*leaves.flags())
    column = leaves.columns()
    dates = {str(k): k for q in queries.values() for k in _dates(q)}
    if dates:
        flagged = flagged.join(docs.select("doc_id", "dcom"), "doc_id", "left")
        for name, k in dates.items():
            low, _, high = k.text.partition(":")
            column[name] = F.coalesce(F.date_format("dcom", "yyyy/MM").between(low[:7], (high or low)[:7]), F.lit(False))
    parts = []
    for topic, root in queries.items():
        for i, (node, _) in enumerate(walk(root)):
            if nodes or i == 0:
                parts.append(F.when(_evaluate(node, column), F.struct(F.lit(topic).alias("topic"), F.lit(i).alias("node_id"))))
    hits = flagged.select("doc_id", F.explode(F.array_compact(F.array(*parts))).alias("h"))
    return hits.select("h.topic", "h.node_id", "doc_id") if nodes else hits.select("h.topic", "doc_id")


def matching_rows(queries: Mapping[str, Node], docs: DataFrame) -> DataFrame:
    """The same documents from the texts, in one scan without a shuffle: best for many clauses and no index."""
    held = docs.select("doc_id", "dcom", F.coalesce(terms("ti"), F.array()).alias("ti"), F.coalesce(terms("ab"), F.array()).alias("ab"), F.coalesce(F.transform("mh", lambda h: F.lower(F.trim(h))), F.array()).alias("mh"))

    def has(field: str, word: str, prefix: bool) -> Column:
        return F.coalesce(F.exists(field, lambda t: t.startswith(word)) if prefix else F.array_contains(field, word), F.lit(False))

    def leaf(k: Keyword) -> Column:
        if k.fields == (DATE,):
            low, _, high = k.text.partition(":")
            return F.coalesce(F.date_format("dcom", "yyyy/MM").between(low[:7], (high or low)[:7]), F.lit(False))
        options = [reduce(lambda a, b: a & b, [has(f, w, p) for w, p in _words(k, f)]) for f in index_fields(k) if _words(k, f)]
        return reduce(lambda a, b: a | b, options) if options else F.lit(False)

    parts = []
    for topic, root in queries.items():
        column = {str(k): leaf(k) for k in keywords(root)}
        parts.append(F.when(_evaluate(root, column), F.lit(topic)))
    return held.select("doc_id", F.explode(F.array_compact(F.array(*parts))).alias("topic")).select("topic", "doc_id")


def node_sizes(queries: Mapping[str, Node], postings: DataFrame, qrels: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(topic, node_id, n, r): documents retrieved by every node, and how many of them ``qrels`` (topic, doc_id) has."""
    hits = matching(queries, postings, docs, nodes=True)
    if qrels is None:
        return hits.groupBy("topic", "node_id").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("r"))
    judged = hits.join(qrels.select("topic", "doc_id", F.lit(1).alias("is_rel")).distinct(), ["topic", "doc_id"], "left")
    return judged.groupBy("topic", "node_id").agg(F.count(F.lit(1)).alias("n"), F.count("is_rel").alias("r"))


def set_combine(operator: str, sets: DataFrame, members: list[int], key: str = "doc_id") -> DataFrame:
    """(key): named sets (set_id, key) combined by and, or, not in one aggregation; ``members`` in order, the first one being the minuend."""
    if not members:
        return sets.select(key).limit(0)
    flags = [F.max(F.col("set_id") == m).alias(f"m{m}") for m in members]
    held = sets.where(F.col("set_id").isin(members)).groupBy(key).agg(*flags)
    return held.where(combine(operator, [F.col(f"m{m}") for m in members])).select(key)


def adjacent(positions: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """(doc_id): true adjacency as an extension: both terms in a field at most ``distance`` apart. ``positions`` has doc_id, field, term, i."""
    a = positions.where(F.col("term") == first).select("doc_id", "field", F.col("i").alias("a"))
    b = positions.where(F.col("term") == second).select("doc_id", "field", F.col("i").alias("b"))
    return a.join(b, ["doc_id", "field"]).where(F.abs(F.col("a") - F.col("b")) <= distance).select("doc_id").distinct()


def as_run(hits: DataFrame, run_name: str) -> DataFrame:
    """Matching documents as run rows: iteration Q0, rank from 0 by document id, score 0."""
    from pyspark.sql import Window

    order = Window.partitionBy("topic").orderBy("doc_id")
    return hits.select("topic", F.lit("Q0").alias("iteration"), F.col("doc_id").cast("string").alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("rank"), F.lit(0.0).alias("score"), F.lit(run_name).alias("run_name"))


def relevant_only(query: Node, pmids: list[int]) -> Node:
    """``query AND (pmid OR pmid ...)``."""
    return Boolean("and", (query, Boolean("or", tuple(Keyword(str(p), ("pmid",)) for p in pmids))))
