"""Boolean search queries as immutable trees, and as rows of nodes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

TITLE, ABSTRACT, TEXT, ALL = "title", "abstract", "text_word", "all_fields"
MESH, MESH_MAJOR, MESH_FLOATING, MESH_MAJOR_FLOATING = "mesh_headings", "mesh_major", "mesh_floating", "mesh_major_floating"
DATE, PUBLICATION_TYPE = "publication_date", "publication_type"
MESH_FIELDS = (MESH, MESH_MAJOR, MESH_FLOATING, MESH_MAJOR_FLOATING)


@dataclass(frozen=True)
class Keyword:
    text: str
    fields: tuple[str, ...] = (TITLE, ABSTRACT)
    exploded: bool | None = None
    truncated: bool = False
    options: tuple[tuple[str, str], ...] = ()

    def __str__(self) -> str:
        marks = "".join(("+" if self.exploded else "", "*" if self.truncated and not self.text.endswith("*") else ""))
        return f"{self.text}{marks}[{','.join(self.fields)}]"


@dataclass(frozen=True)
class Boolean:
    operator: str  # and, or, not, adj, adjN
    children: tuple["Node", ...] = field(default=())

    def __str__(self) -> str:
        return f"({f' {self.operator} '.join(map(str, self.children))})"


Node = Keyword | Boolean


def walk(node: Node, depth: int = 0) -> Iterator[tuple[Node, int]]:
    yield node, depth
    if isinstance(node, Boolean):
        for child in node.children:
            yield from walk(child, depth + 1)


def keywords(node: Node) -> list[Keyword]:
    return [n for n, _ in walk(node) if isinstance(n, Keyword)]


def booleans(node: Node) -> list[Boolean]:
    return [n for n, _ in walk(node) if isinstance(n, Boolean)]


def rewrite(node: Node, keyword: Callable[[Keyword], Node] = lambda k: k, boolean: Callable[[Boolean], Node] = lambda b: b) -> Node:
    """The tree with ``keyword`` applied to leaves and ``boolean`` to inner nodes, from the leaves up."""
    if isinstance(node, Keyword):
        return keyword(node)
    return boolean(replace(node, children=tuple(rewrite(c, keyword, boolean) for c in node.children)))


def to_json(node: Node) -> str:
    def plain(n: Node) -> dict:
        if isinstance(n, Boolean):
            return {"operator": n.operator, "children": [plain(c) for c in n.children]}
        options = dict(n.options) | ({} if n.exploded is None else {"exploded": n.exploded}) | ({"truncated": True} if n.truncated else {})
        return {"query": n.text, "fields": list(n.fields), "options": options}

    return json.dumps(plain(node), ensure_ascii=False)


def from_json(text: str) -> Node:
    def node(x: dict) -> Node:
        if "operator" in x:
            return Boolean(x["operator"].lower(), tuple(node(c) for c in x.get("children") or ()))
        options = dict(x.get("options") or {})
        return Keyword(x["query"], tuple(x.get("fields") or ()), options.pop("exploded", None), bool(options.pop("truncated", False)), tuple(sorted((k, str(v)) for k, v in options.items())))

    return node(json.loads(text))


NODE_FIELDS = [
    ("node_id", T.IntegerType()), ("parent_id", T.IntegerType()), ("ord", T.IntegerType()), ("depth", T.IntegerType()), ("kind", T.StringType()), ("operator", T.StringType()),
    ("query_string", T.StringType()), ("fields", T.ArrayType(T.StringType())), ("exploded", T.BooleanType()), ("truncated", T.BooleanType()), ("top", T.IntegerType()),
]


def node_rows(root: Node) -> list[tuple]:
    """Rows of ``NODE_FIELDS`` in pre-order; ``top`` is the node of the root's child above each node."""
    rows: list[tuple] = []

    def put(n: Node, parent: int | None, ord_: int, depth: int, top: int | None) -> None:
        i = len(rows)
        top = i if depth == 1 else top
        if isinstance(n, Keyword):
            rows.append((i, parent, ord_, depth, "kw", None, n.text, list(n.fields), n.exploded, n.truncated, top))
        else:
            rows.append((i, parent, ord_, depth, "bool", n.operator, None, None, None, None, top))
            for k, child in enumerate(n.children):
                put(child, i, k, depth + 1, top)

    put(root, None, 0, 0, None)
    return rows
