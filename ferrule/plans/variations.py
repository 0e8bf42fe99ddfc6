"""Single-edit variations of query trees and the features that describe them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from ferrule.plans.ast import ABSTRACT, MESH, MESH_FIELDS, TITLE, Boolean, Keyword, Node, keywords, walk

#: Ids of the transformations.
LOGICAL, ADJ_RANGE, MESH_EXPLOSION, FIELD_RESTRICTION, ADJ_REPLACEMENT, CLAUSE_REMOVAL, EMBEDDING_EXPANSION, MESH_PARENT = range(8)
#: Ids of the features.
DEPTH, CLAUSE_TYPE, CHILDREN, TRANSFORMATION, LOGICAL_TYPE, ADJ_REPLACED, ADJ_DISTANCE, MESH_DEPTH, MESH_PARENT_USED, RESTRICTION, REMOVAL, EXPANSION, EXPANSIONS, EXPLODED, TRUNCATED, N_FIELDS, OPERATOR = range(1, 18)
MEASURE_BASE, DELTA_BASE, CHAIN_BASE = 18, 38, 60
OPERATOR_CODES = {"or": 1, "and": 2, "not": 3}


@dataclass(frozen=True)
class Candidate:
    query: Node
    transformation: int
    depth: int = 0
    chain: tuple[int, ...] = ()
    features: Mapping[int, float] = field(default_factory=dict)


def logical_operator(b: Node) -> list[Node]:
    """and and or exchanged."""
    if isinstance(b, Boolean) and b.operator in ("and", "or"):
        return [replace(b, operator="or" if b.operator == "and" else "and")]
    return []


def _distance(b: Boolean) -> int:
    return int(b.operator[3:] or 1)


def adjacency_range(b: Node) -> list[Node]:
    """One word nearer (not below 1) and one further."""
    if isinstance(b, Boolean) and b.operator.startswith("adj"):
        n = _distance(b)
        return [replace(b, operator=f"adj{m}") for m in (n - 1, n + 1) if m >= 1]
    return []


def adjacency_replacement(b: Node) -> list[Node]:
    return [replace(b, operator="and")] if isinstance(b, Boolean) and b.operator.startswith("adj") else []


def clause_removal(b: Node) -> list[Node]:
    """Each child left out once, if one remains."""
    if isinstance(b, Boolean) and len(b.children) > 1:
        return [replace(b, children=b.children[:i] + b.children[i + 1 :]) for i in range(len(b.children))]
    return []


def mesh_explosion(k: Node) -> list[Node]:
    return [replace(k, exploded=not k.exploded)] if isinstance(k, Keyword) and MESH in k.fields and k.exploded is not None else []


def field_restrictions(k: Node) -> list[Node]:
    """Only title: abstract, or both; only abstract: title, or both; both: either dropped."""
    if not isinstance(k, Keyword):
        return []
    here = tuple(f for f in k.fields if f in (TITLE, ABSTRACT))
    rest = tuple(f for f in k.fields if f not in (TITLE, ABSTRACT))
    options = {(TITLE,): [(ABSTRACT,), (TITLE, ABSTRACT)], (ABSTRACT,): [(TITLE,), (TITLE, ABSTRACT)], (TITLE, ABSTRACT): [(ABSTRACT,), (TITLE,)]}
    return [replace(k, fields=o + rest) for o in options.get(here, [])]


def embedding_expansion(nearest: Mapping[str, list[str]]) -> Callable[[Node], list[Node]]:
    """A keyword with the terms nearest to it, as a disjunction; ``nearest`` maps lower-case keywords to terms."""

    def run(k: Node) -> list[Node]:
        near = nearest.get(k.text.lower(), []) if isinstance(k, Keyword) and not set(k.fields) & set(MESH_FIELDS) else []
        return [Boolean("or", (*[replace(k, text=t) for t in near], k))] if near else []

    return run


def mesh_parent(parents: Mapping[str, list[str]]) -> Callable[[Node], list[Node]]:
    """A heading replaced by its parents, not exploded."""

    def run(k: Node) -> list[Node]:
        if not isinstance(k, Keyword) or MESH not in k.fields:
            return []
        up = parents.get(k.text.lower(), [])
        new = [replace(k, text=p, exploded=False) for p in up]
        return [new[0]] if len(new) == 1 else [Boolean("or", tuple(new))] if new else []

    return run


TRANSFORMERS: dict[int, Callable[[Node], list[Node]]] = {
    LOGICAL: logical_operator, ADJ_RANGE: adjacency_range, MESH_EXPLOSION: mesh_explosion, FIELD_RESTRICTION: field_restrictions, ADJ_REPLACEMENT: adjacency_replacement, CLAUSE_REMOVAL: clause_removal,
}


def _places(node: Node, depth: int = 0, parent: str = ""):
    """(node, depth, parent's operator, rebuild) for every node."""
    yield node, depth, parent, lambda new: new
    if isinstance(node, Boolean):
        for i, child in enumerate(node.children):
            for n, d, p, build in _places(child, depth + 1, node.operator):
                yield n, d, p, lambda new, i=i, build=build: replace(node, children=node.children[:i] + (build(new),) + node.children[i + 1 :])


def keyword_features(ks: list[Keyword]) -> dict[int, float]:
    return {
        EXPLODED: float(sum(1 for k in ks if k.exploded)), TRUNCATED: float(sum(1 for k in ks if k.truncated)), N_FIELDS: float(sum(len(k.fields) for k in ks)),
    }


def features(new: Node, old: Node, transformation: int, depth: int, parent: str, measures: Mapping[str, Callable[[Node], float]], before: Node, after: Node) -> dict[int, float]:
    out = {DEPTH: float(depth), CLAUSE_TYPE: float(OPERATOR_CODES.get(parent, 4 if parent.startswith("adj") else 0)), CHILDREN: float(len(old.children) if isinstance(old, Boolean) else 0), TRANSFORMATION: float(transformation)}
    out |= keyword_features(keywords(new))
    if isinstance(new, Boolean):
        out[OPERATOR] = float(OPERATOR_CODES.get(new.operator, 4))
    if transformation == LOGICAL:
        out[LOGICAL_TYPE] = 1.0 if new.operator == "or" else 2.0
    elif transformation == ADJ_RANGE:
        out[ADJ_DISTANCE] = float(_distance(new))
    elif transformation == ADJ_REPLACEMENT:
        out[ADJ_REPLACED] = 1.0
    elif transformation == FIELD_RESTRICTION:
        out[RESTRICTION] = {(TITLE,): 1.0, (ABSTRACT,): 2.0}.get(tuple(f for f in new.fields if f in (TITLE, ABSTRACT)), 3.0)
    elif transformation == CLAUSE_REMOVAL:
        out[REMOVAL] = 1.0
    elif transformation == EMBEDDING_EXPANSION:
        out[EXPANSION], out[EXPANSIONS] = 1.0, float(len(new.children) - 1)
    elif transformation == MESH_PARENT:
        out[MESH_PARENT_USED] = 1.0
    for i, fn in enumerate(measures.values()):
        a, b = fn(before), fn(after)
        out[MEASURE_BASE + i], out[DELTA_BASE + i] = b, a - b
    return {k: v for k, v in out.items() if v}


#: Measures of a tree that features hold with their change.
MEASURES: dict[str, Callable[[Node], float]] = {
    "keywords": lambda n: float(len(keywords(n))), "booleans": lambda n: float(sum(isinstance(x, Boolean) for x, _ in walk(n))), "depth": lambda n: float(max(d for _, d in walk(n))),
    "mesh": lambda n: float(sum(MESH in k.fields for k in keywords(n))), "truncated": lambda n: float(sum(k.truncated for k in keywords(n))),
}


def variations(candidate: Candidate, transformers: Mapping[int, Callable[[Node], list[Node]]] = TRANSFORMERS, measures: Mapping[str, Callable[[Node], float]] = MEASURES) -> list[Candidate]:
    """Every query one edit away, each once, in a fixed order; the query itself is none."""
    seen, out = {str(candidate.query)}, []
    for tid, transform in transformers.items():
        for node, depth, parent, build in _places(candidate.query):
            for new in transform(node):
                query = build(new)
                if str(query) in seen:
                    continue
                seen.add(str(query))
                made = features(new, node, tid, depth, parent, measures, candidate.query, query)
                made |= {CHAIN_BASE + i: float(t) for i, t in enumerate(candidate.chain)}
                out.append(Candidate(query, tid, candidate.depth + 1, (*candidate.chain, tid), made))
    return out
