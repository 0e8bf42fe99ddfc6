"""Rewrites of query trees. Each is a pure function; trees are small, so this is driver work."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from ferrule.functions.text import porter_stem
from ferrule.plans.ast import ABSTRACT, ALL, DATE, MESH, MESH_FIELDS, MESH_FLOATING, PUBLICATION_TYPE, TEXT, TITLE, Boolean, Keyword, Node, keywords, rewrite


def process(node: Node, fn: Callable[[str], str]) -> Node:
    """``fn`` applied to every keyword's text."""
    return rewrite(node, lambda k: replace(k, text=fn(k.text)))


def simplify_operators(node: Node) -> Node:
    """Every operator but ``and`` becomes ``or``."""
    return rewrite(node, boolean=lambda b: replace(b, operator="and" if b.operator == "and" else "or"))


def all_and(node: Node) -> Node:
    return rewrite(node, boolean=lambda b: replace(b, operator="and"))


def all_or(node: Node) -> Node:
    return rewrite(node, boolean=lambda b: replace(b, operator="or"))


def _is_mesh(k: Keyword) -> bool:
    return bool(k.fields) and k.fields[0] in MESH_FIELDS


def relax_phrases(node: Node) -> Node:
    """A phrase that is no heading becomes the disjunction of its words."""

    def relax(k: Keyword) -> Node:
        words = k.text.replace('"', "").split()
        return k if _is_mesh(k) or len(words) < 2 else Boolean("or", tuple(replace(k, text=w, truncated=w.endswith("*")) for w in words))

    return rewrite(node, relax)


def no_explosion(node: Node) -> Node:
    return rewrite(node, lambda k: replace(k, exploded=False))


def _any(*terms: tuple[str, tuple[str, ...]] | tuple[str, tuple[str, ...], bool]) -> Boolean:
    return Boolean("or", tuple(Keyword(*t) for t in terms))


_TIAB, _PT = (TITLE, ABSTRACT), (PUBLICATION_TYPE,)
#: The clauses that restrict a query to randomised trials.
RCT = _any(
    ("Randomized Controlled Trials As Topic", (MESH,), True), ("Randomized Controlled Trial", _PT), ("Controlled Clinical Trial", _PT),
    ("randomized", (TEXT,)), ("placebo", (TEXT,)), ("randomly", (TEXT,)), ("trial", (TITLE,)),
)
#: The public search filter for trials, sensitivity-maximising.
SENSITIVE = _any(
    ("randomized controlled trial", _PT), ("controlled clinical trial", _PT), ("randomized", _TIAB), ("placebo", _TIAB),
    ("drug therapy", (MESH_FLOATING,)), ("randomly", _TIAB), ("trial", _TIAB), ("groups", _TIAB),
)
#: The same filter, sensitivity- and precision-maximising.
PRECISE = _any(
    ("randomized controlled trial", _PT), ("controlled clinical trial", _PT), ("randomized", _TIAB), ("placebo", _TIAB),
    ("clinical trials as topic", (MESH,), False), ("randomly", _TIAB), ("trial", (TITLE,)),
)
#: The records that both filters leave out.
ONLY_ANIMALS = Boolean("not", (Keyword("animals", (MESH,)), Keyword("humans", (MESH,))))


def rct_filter(node: Node) -> Node:
    """A Boolean query restricted to randomised trials; a keyword is returned as it is."""
    return Boolean("and", (node, RCT)) if isinstance(node, Boolean) else node


def sensitivity_filter(node: Node) -> Node:
    return Boolean("and", (node, Boolean("not", (SENSITIVE, ONLY_ANIMALS))))


def precision_sensitivity_filter(node: Node) -> Node:
    return Boolean("and", (node, Boolean("not", (PRECISE, ONLY_ANIMALS))))


def date_restriction(node: Node, topic: str, restrictions: Mapping[str, tuple[str, str]]) -> Node:
    """The query restricted to its topic's months (YYYY/MM), where the topic has a restriction."""
    if topic not in restrictions:
        return node
    start, end = restrictions[topic]
    return Boolean("and", (node, Keyword(f"{start}:{end}", (DATE,))))


def analyse(node: Node, analyser: Callable[[str], list[str]]) -> Node:
    """Keywords re-tokenised by ``analyser``."""
    return rewrite(node, lambda k: replace(k, text=" ".join(analyser(k.text))))


def analysed_fields(node: Node, suffix: str = ".stemmed") -> Node:
    """Truncated keywords use the analysed sub-fields and lose their mark, others the plain ones; adj stays only over truncated keywords and else becomes and."""

    def keyword(k: Keyword) -> Keyword:
        plain = tuple(f.removesuffix(suffix) for f in k.fields)
        return replace(k, text=k.text.rstrip("*"), fields=tuple(f + suffix for f in plain)) if k.truncated else replace(k, fields=plain)

    def boolean(b: Boolean) -> Boolean:
        return replace(b, operator="and") if b.operator.startswith("adj") and not all(k.truncated for k in keywords(b)) else b

    return rewrite(node, keyword, boolean)


def remove_mesh(node: Node) -> tuple[Node | None, list[Keyword]]:
    """The query without its headings, and the headings; groups that lose all children go too."""
    gone = [k for k in keywords(node) if _is_mesh(k)]

    def drop(n: Node) -> Node | None:
        if isinstance(n, Keyword):
            return None if _is_mesh(n) else n
        kept = tuple(c for c in map(drop, n.children) if c is not None)
        return replace(n, children=kept) if kept else None

    return drop(node), gone


def flatten(node: Node) -> Node | None:
    """Nested groups of the same and/or operator merged, empty keywords and groups dropped, groups of one replaced by their child."""
    if isinstance(node, Keyword):
        return node if node.text.strip() else None
    children: list[Node] = []
    for c in map(flatten, node.children):
        if isinstance(c, Boolean) and c.operator == node.operator and node.operator in ("and", "or"):
            children += c.children
        elif c is not None:
            children.append(c)
    if not children:
        return None
    return children[0] if len(children) == 1 else replace(node, children=tuple(children))


def stem(node: Node, originals: list[Keyword]) -> Node:
    """Keywords that contain the stem of a truncated original are replaced by it, each original at most once."""
    left = [o for o in originals if o.truncated]

    def swap(k: Keyword) -> Keyword:
        for o in left:
            if o.text.rstrip("*").lower() in k.text.lower():
                left.remove(o)
                return replace(o, fields=k.fields)
        return k

    return rewrite(node, swap)


def title_clause(title: str, stopwords: list[str]) -> Boolean:
    """The words of a title as truncated Porter stems and as words."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in title.lower()).split() if w not in stopwords]
    return Boolean("or", tuple(k for w in dict.fromkeys(words) for k in (Keyword(porter_stem(w) + "*", _TIAB, truncated=True), Keyword(w, _TIAB))))


#: Words of studies of diagnostic tests.
DIAGNOSTIC_TERMS = ["sensitivity", "specificity", "diagnosis", "diagnostic", "predictive", "accuracy"]


def expand_query(node: Node, title: str, stopwords: list[str], diagnostic: bool = True) -> Node:
    """``node AND diagnostic terms AND title terms`` as alternatives of one more clause each."""
    extra = [title_clause(title, stopwords)] + ([Boolean("or", tuple(Keyword(t, _TIAB) for t in DIAGNOSTIC_TERMS))] if diagnostic else [])
    return Boolean("or", (node, *extra))


def relax_fields(node: Node) -> Node:
    return rewrite(node, lambda k: replace(k, fields=(ALL,)))


REWRITES: dict[str, Callable[[Node], Node | None]] = {
    "simplify_operators": simplify_operators, "all_and": all_and, "all_or": all_or, "relax_phrases": relax_phrases, "no_explosion": no_explosion, "rct_filter": rct_filter,
    "sensitivity_filter": sensitivity_filter, "precision_sensitivity_filter": precision_sensitivity_filter, "remove_mesh": lambda n: remove_mesh(n)[0], "flatten": flatten, "analysed_fields": analysed_fields,
}
