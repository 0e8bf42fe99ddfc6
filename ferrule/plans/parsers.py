"""Search query texts (Ovid MEDLINE lines, PubMed brackets, JSON trees) to query trees, and back."""

from __future__ import annotations

import re

from ferrule.plans.ast import ABSTRACT, ALL, DATE, MESH, MESH_FLOATING, MESH_FIELDS, MESH_MAJOR, MESH_MAJOR_FLOATING, PUBLICATION_TYPE, TEXT, TITLE, Boolean, Keyword, Node, from_json, rewrite, to_json

#: The field tags of the two query languages.
OVID_FIELDS = {
    "ti": (TITLE,), "ab": (ABSTRACT,), "tw": (TITLE, ABSTRACT), "mp": (TITLE, ABSTRACT, MESH), "af": (ALL,), "sh": (MESH,), "hw": (MESH_FLOATING,), "pt": (PUBLICATION_TYPE,), "kw": (TEXT,), "fs": (MESH_FLOATING,),
}
PUBMED_FIELDS = {
    "title": (TITLE,), "ti": (TITLE,), "abstract": (ABSTRACT,), "ab": (ABSTRACT,), "title/abstract": (TITLE, ABSTRACT), "tiab": (TITLE, ABSTRACT), "text word": (TEXT,), "tw": (TEXT,),
    "all fields": (ALL,), "all": (ALL,), "mesh terms": (MESH,), "mesh": (MESH,), "mh": (MESH,), "mesh:noexp": (MESH,), "mh:noexp": (MESH,), "mesh major topic": (MESH_MAJOR,), "majr": (MESH_MAJOR,),
    "mesh subheading": (MESH_FLOATING,), "sh": (MESH_FLOATING,), "publication type": (PUBLICATION_TYPE,), "pt": (PUBLICATION_TYPE,), "publication date": (DATE,), "pdat": (DATE,), "dp": (DATE,),
}
DEFAULT = (TITLE, ABSTRACT)
_OPERATOR = re.compile(r"(and|or|not|adj\d*)(?![\w/])", re.IGNORECASE)
_COMBINED = re.compile(r"(and|or)/\s*([\d\-,\s]*\d)", re.IGNORECASE)
_EXPLODED = re.compile(r"exp\s+(\*?)([^/()\[\]]+)/(?:[a-z]{2}(?:,\s*[a-z]{2})*)?", re.IGNORECASE)
_HEADING = re.compile(r"(\*?)([A-Za-z][^/()\[\]\".]*)/(?:[a-z]{2}(?:,\s*[a-z]{2})*)?(?=\s|\)|$)")
_DATES = re.compile(r"(\d{4}(?:/\d\d){0,2}:\d{4}(?:/\d\d){0,2})")
_WORD = re.compile(r"[^\s()\[\]\"]+")
_QUOTED = re.compile(r"\"([^\"]*)\"([*$]?)")
_SUFFIX = re.compile(r"\.([a-z]{2}(?:,[a-z]{2})*)\.?(?=\s|\)|$)", re.IGNORECASE)
_BRACKET = re.compile(r"\s*\[([^\]]+)\]")
_LINE = re.compile(r"^\s*(\d+)[.:)]?\s+(.*\S)\s*$")


class QuerySyntaxError(ValueError):
    pass


class _Parser:
    """Recursive descent: adjacency binds tightest, then and/not, then or (``flat``: strictly from left to right)."""

    def __init__(self, text: str, lines: dict[int, Node] | None = None, flat: bool = False):
        self.text, self.at, self.lines, self.flat = text, 0, lines, flat

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, pattern: re.Pattern) -> re.Match | None:
        if found := pattern.match(self.text, self.at):
            self.at = found.end()
        return found

    def operator(self, accept: tuple[str, ...]) -> str | None:
        self.blank()
        found = _OPERATOR.match(self.text, self.at)
        if not found:
            return None
        name = found[1].lower()
        if (name[:3] if name.startswith("adj") else name) not in accept:
            return None
        self.at = found.end()
        return name

    def chain(self, below, accept: tuple[str, ...]) -> Node:
        left = below()
        while name := self.operator(accept):
            right = below()
            if isinstance(left, Boolean) and left.operator == name and name in ("and", "or") and not getattr(self, "closed", None) is left:
                left = Boolean(name, (*left.children, right))
            else:
                left = Boolean(name, (left, right))
        return left

    def expression(self) -> Node:
        if self.flat:
            return self.chain(self.atom, ("and", "or", "not", "adj"))
        return self.chain(lambda: self.chain(lambda: self.chain(self.atom, ("adj",)), ("and", "not")), ("or",))

    def atom(self) -> Node:
        self.blank()
        if self.at >= len(self.text):
            raise QuerySyntaxError(f"the query ends early: {self.text!r}")
        if self.text[self.at] == "(":
            self.at += 1
            inner = self.expression()
            self.blank()
            if self.text[self.at : self.at + 1] != ")":
                raise QuerySyntaxError(f"no closing bracket at {self.at}: {self.text!r}")
            self.at += 1
            if fields := self.fields():
                inner = rewrite(inner, lambda k: Keyword(k.text, fields, k.exploded, k.truncated, k.options) if k.fields == DEFAULT else k)
            self.closed = inner
            return inner
        if (found := self.take(_COMBINED)) and self.lines is not None:
            return Boolean(found[1].lower(), tuple(self.line(i) for i in _numbers(found[2])))
        if found := self.take(_EXPLODED):
            return Keyword(found[2].strip(), (MESH_MAJOR if found[1] else MESH,), True)
        if found := self.take(_DATES):
            return Keyword(found[1], self.fields() or (DATE,))
        if (found := _HEADING.match(self.text, self.at)) and not re.search(r"\s(and|or|not|adj\d*)\s", found[2], re.IGNORECASE):
            self.at = found.end()
            return Keyword(found[2].strip(), (MESH_MAJOR if found[1] else MESH,), False)
        return self.words()

    def words(self) -> Node:
        parts, truncated, fields = [], False, None
        while fields is None:
            self.blank()
            if found := self.take(_QUOTED):
                parts.append(found[1])
                truncated |= bool(found[2])
                fields = self.fields()
                if fields is None:
                    break
            elif self.at >= len(self.text) or self.text[self.at] in "()[" or (parts and _OPERATOR.match(self.text, self.at)):
                break
            else:
                word = self.take(_WORD)[0]
                if parts == [] and word.isdigit() and self.lines is not None:
                    return self.line(int(word))
                if cut := re.search(r"\.([A-Za-z]{2}(?:,[A-Za-z]{2})*)\.?$", word):
                    if named := _named(cut[1].split(","), OVID_FIELDS):
                        word, fields = word[: cut.start()], named
                parts.append(word)
                fields = fields or self.bracket()
        text = " ".join(p for p in parts if p)
        if not text:
            raise QuerySyntaxError(f"no term at {self.at}: {self.text!r}")
        truncated |= text.endswith(("*", "$"))
        exploded = True if fields and fields[0] in MESH_FIELDS and len(fields) == 1 else None
        if self.noexp:
            exploded = False
        return Keyword(text.replace("$", "*"), fields or DEFAULT, exploded, truncated)

    noexp = False

    def bracket(self) -> tuple[str, ...] | None:
        self.noexp = False
        if found := self.take(_BRACKET):
            name = found[1].strip().lower()
            self.noexp = name.endswith(":noexp")
            if name not in PUBMED_FIELDS:
                raise QuerySyntaxError(f"unknown field {found[1]!r}")
            return PUBMED_FIELDS[name]
        return None

    def fields(self) -> tuple[str, ...] | None:
        if found := _SUFFIX.match(self.text, self.at):
            if named := _named(found[1].lower().split(","), OVID_FIELDS):
                self.at = found.end()
                return named
        return self.bracket()

    def line(self, number: int) -> Node:
        if number not in self.lines:
            raise QuerySyntaxError(f"no line {number}")
        return self.lines[number]

    def whole(self) -> Node:
        node = self.expression()
        self.blank()
        if self.at < len(self.text):
            raise QuerySyntaxError(f"unread rest at {self.at}: {self.text!r}")
        return node


def _named(names: list[str], known: dict) -> tuple[str, ...] | None:
    if any(n.lower() not in known for n in names):
        return None
    return tuple(dict.fromkeys(f for n in names for f in known[n.lower()]))


def _numbers(text: str) -> list[int]:
    out: list[int] = []
    for part in text.replace(" ", "").split(","):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return out


def parse_expression(text: str) -> Node:
    """One query in either notation, or both mixed."""
    return _Parser(text).whole()


def parse_pubmed(text: str) -> Node:
    """PubMed notation; operators apply from left to right."""
    return _Parser(" ".join(text.split()), flat=True).whole()


def parse_medline(text: str) -> Node:
    """Ovid notation: numbered lines that may refer to earlier ones; the last line is the query. Unnumbered text is one expression."""
    lines: dict[int, Node] = {}
    last: Node | None = None
    for raw in text.splitlines():
        if not raw.strip():
            continue
        if found := _LINE.match(raw):
            last = lines[int(found[1])] = _Parser(found[2], lines).whole()
        else:
            last = _Parser(raw.strip(), lines).whole()
            lines[max(lines, default=0) + 1] = last
    if last is None:
        raise QuerySyntaxError("an empty query")
    return last


PARSERS = {"medline": parse_medline, "pubmed": parse_pubmed, "cqr": from_json, "expression": parse_expression}

_PUBMED_OUT = {TITLE: "Title", ABSTRACT: "Abstract", TEXT: "Text Word", ALL: "All Fields", MESH: "Mesh Terms", MESH_MAJOR: "MeSH Major Topic", MESH_FLOATING: "MeSH Subheading", MESH_MAJOR_FLOATING: "MeSH Major Topic", DATE: "Publication Date", PUBLICATION_TYPE: "Publication Type"}
_OVID_OUT = {TITLE: "ti", ABSTRACT: "ab", TEXT: "kw", ALL: "af", MESH_FLOATING: "hw", PUBLICATION_TYPE: "pt"}


def to_pubmed(node: Node) -> str:
    if isinstance(node, Boolean):
        name = "AND" if node.operator.startswith("adj") else node.operator.upper()
        return f"({f' {name} '.join(map(to_pubmed, node.children))})"
    text = node.text if " " not in node.text or node.text.startswith('"') else f'"{node.text}"'
    tags = ["Title/Abstract"] if set(node.fields) == {TITLE, ABSTRACT} else [_PUBMED_OUT.get(f, "All Fields") for f in node.fields]
    noexp = ":noexp" if node.exploded is False and node.fields and node.fields[0] in MESH_FIELDS else ""
    parts = [f"{text}[{'Mesh' + noexp if noexp else t}]" for t in tags]
    return parts[0] if len(parts) == 1 else f"({' OR '.join(parts)})"


def to_medline(node: Node) -> str:
    """Numbered lines; every inner node is a line that refers to its children's."""
    lines: list[str] = []

    def put(n: Node) -> int:
        if isinstance(n, Boolean):
            refs = [put(c) for c in n.children]
            lines.append(f" {n.operator} ".join(map(str, refs)))
        elif n.fields and n.fields[0] in MESH_FIELDS:
            lines.append(f"{'exp ' if n.exploded else ''}{'*' if n.fields[0] == MESH_MAJOR else ''}{n.text}/")
        else:
            text = n.text if " " not in n.text else f'"{n.text}"'
            tags = ["mp"] if n.fields == OVID_FIELDS["mp"] else dict.fromkeys(_OVID_OUT.get(f, "sh") for f in n.fields)
            lines.append(f"{text}.{','.join(tags)}.")
        return len(lines)

    put(node)
    return "\n".join(f"{i}. {line}" for i, line in enumerate(lines, 1))


PRINTERS = {"medline": to_medline, "pubmed": to_pubmed, "cqr": to_json}
