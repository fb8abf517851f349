"""Turtle, TriG and RDF/XML to quads, after the W3C grammars. Pure Python, for use within tasks."""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from ..terms import RDF, XSD

Quad = tuple[str, str, str, str, str, str | None, str | None, str | None]
Node = tuple[str, str, str | None, str | None]

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix|@base)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]|\.(?=[\w\-:.%\\]))*)?)
    |(?P<word>[A-Za-z]+)|(?P<op>\^\^|[{}()\[\].,;=])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    def one(m):
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S)


def resolve(base: str, iri: str) -> str:
    """``iri`` against ``base``; an absolute one stays as it is, and an empty fragment stays too."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri):
        return iri
    return urljoin(base, iri) + ("#" if iri.endswith("#") else "")


class Turtle:
    """Turtle and TriG. ``scope`` keeps blank nodes of different files apart, and the same in every run."""

    def __init__(self, text: str, base: str = "", scope: str = "", graph: str | None = None):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"cannot read Turtle at {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
        self.at, self.base, self.prefixes, self.scope, self.fresh, self.graph, self.default = 0, base, {}, scope, 0, graph, graph
        self.out: list[Quad] = []

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self):
        t = self.peek()
        self.at += 1
        return t

    def op(self, x: str) -> bool:
        if self.peek() == ("op", x):
            self.at += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.op(x):
            raise ValueError(f"expected {x!r}, got {self.peek()[1]!r}")

    def blank(self, name: str | None = None) -> Node:
        if name is None:
            self.fresh += 1
            name = f"\x00{self.fresh}"
        return "_:b" + uuid.uuid5(uuid.NAMESPACE_OID, self.scope + "\x1f" + name).hex[:24], "bnode", None, None

    def parse(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, v = self.peek()
            low = v.lower()
            if kind == "directive" or kind == "word" and low in ("prefix", "base"):
                self.next()
                if low.endswith("prefix"):
                    name = self.next()[1][:-1]
                    self.prefixes[name] = self.iri(self.next()[1])
                else:
                    self.base = self.iri(self.next()[1])
                self.op(".")
            elif kind == "word" and low == "graph":
                self.next()
                self.block(self.node()[0])
            elif kind == "op" and v == "{":
                self.block(self.default)
            else:
                start = self.at
                if kind in ("iri", "pname", "bnode"):
                    name = self.node()[0]
                    if self.peek() == ("op", "{"):
                        self.block(name)
                        continue
                    self.at = start
                self.statement()
                self.need(".")
        return self.out

    def block(self, graph: str | None) -> None:
        self.need("{")
        self.graph = graph
        while not self.op("}"):
            self.statement()
            if not self.op(".") and self.peek() != ("op", "}"):
                raise ValueError(f"expected '.', got {self.peek()[1]!r}")
        self.graph = self.default

    def iri(self, token: str) -> str:
        return resolve(self.base, unescape(token[1:-1]))

    def add(self, s: Node, p: str, o: Node) -> None:
        self.out.append((s[0], s[1], p, *o, self.graph))

    def statement(self) -> None:
        bracket = self.peek() == ("op", "[")
        s = self.node()
        if not (bracket and self.peek() in (("op", "."), ("op", "}"))):
            self.properties(s)

    def properties(self, s: Node) -> None:
        while True:
            kind, v = self.peek()
            if kind == "word" and v == "a":
                self.next()
                p = RDF + "type"
            else:
                p = self.node()[0]
            self.add(s, p, self.node())
            while self.op(","):
                self.add(s, p, self.node())
            more = False
            while self.op(";"):
                more = True
            if not more or self.peek() in (("op", "."), ("op", "]"), ("op", "}"), ("end", "")):
                return

    def node(self) -> Node:
        kind, v = self.next()
        if kind == "iri":
            return self.iri(v), "iri", None, None
        if kind == "pname":
            prefix, local = v.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "bnode":
            return self.blank(v[2:])
        if kind == "string":
            text = unescape(v[3:-3] if v[:3] in ('"""', "'''") else v[1:-1])
            if self.peek()[0] == "lang":
                return text, "literal", None, self.next()[1][1:]
            if self.op("^^"):
                dt = self.node()[0]
                return text, "literal", None if dt == XSD + "string" else dt, None
            return text, "literal", None, None
        if kind == "number":
            return v, "literal", XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None
        if kind == "word" and v in ("true", "false"):
            return v, "literal", XSD + "boolean", None
        if kind == "op" and v == "[":
            node = self.blank()
            if not self.op("]"):
                self.properties(node)
                self.need("]")
            return node
        if kind == "op" and v == "(":
            head = cell = None
            while not self.op(")"):
                here = self.blank()
                if cell is None:
                    head = here
                else:
                    self.add(cell, RDF + "rest", here)
                cell = here
                self.add(cell, RDF + "first", self.node())
            if cell is None:
                return RDF + "nil", "iri", None, None
            self.add(cell, RDF + "rest", (RDF + "nil", "iri", None, None))
            return head
        raise ValueError(f"expected a term, got {v!r}")


class RdfXml:
    """RDF/XML: typed nodes, nested descriptions, collections, literals, reification ids aside."""

    def __init__(self, data: bytes, base: str = "", scope: str = "", graph: str | None = None):
        self.root, self.base, self.scope, self.graph, self.fresh, self.out = ET.fromstring(data), base, scope, graph, 0, []

    def blank(self, name: str | None = None) -> Node:
        if name is None:
            self.fresh += 1
            name = f"\x00{self.fresh}"
        return "_:b" + uuid.uuid5(uuid.NAMESPACE_OID, self.scope + "\x1f" + name).hex[:24], "bnode", None, None

    def add(self, s: Node, p: str, o: Node) -> None:
        self.out.append((s[0], s[1], p, *o, self.graph))

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def parse(self) -> list[Quad]:
        if self.name(self.root.tag) == RDF + "RDF":
            base = self._base(self.root, self.base)
            for e in self.root:
                self.description(e, base, self._lang(self.root, None))
        else:
            self.description(self.root, self.base, None)
        return self.out

    _XML = "{http://www.w3.org/XML/1998/namespace}"

    def _base(self, e, base: str) -> str:
        return resolve(base, e.get(self._XML + "base", "")) if e.get(self._XML + "base") else base

    def _lang(self, e, lang):
        return e.get(self._XML + "lang", lang) or None

    def description(self, e, base: str, lang: str | None) -> Node:
        base, lang = self._base(e, base), self._lang(e, lang)
        get = lambda n: e.get(f"{{{RDF}}}{n}")
        if get("about") is not None:
            s = (resolve(base, get("about")), "iri", None, None)
        elif get("ID") is not None:
            s = (resolve(base, "#" + get("ID")), "iri", None, None)
        else:
            s = self.blank(get("nodeID"))
        if self.name(e.tag) != RDF + "Description":
            self.add(s, RDF + "type", (self.name(e.tag), "iri", None, None))
        self.attributes(e, s, lang)
        item = 0
        for child in e:
            p = self.name(child.tag)
            if p == RDF + "li":
                item += 1
                p = f"{RDF}_{item}"
            self.add(s, p, self.value(child, base, lang))
        return s

    def attributes(self, e, s: Node, lang: str | None) -> bool:
        any_ = False
        for k, v in e.attrib.items():
            k = self.name(k)
            if k == RDF + "type":
                self.add(s, k, (v, "iri", None, None))
                any_ = True
            elif not k.startswith((RDF, "http://www.w3.org/XML/1998/namespace")) and ":" in k:
                self.add(s, k, (v, "literal", None, lang))
                any_ = True
        return any_

    def value(self, e, base: str, lang: str | None) -> Node:
        base, lang = self._base(e, base), self._lang(e, lang)
        get = lambda n: e.get(f"{{{RDF}}}{n}")
        if get("resource") is not None or get("nodeID") is not None:
            o = (resolve(base, get("resource")), "iri", None, None) if get("resource") is not None else self.blank(get("nodeID"))
            self.attributes(e, o, lang)
            return o
        how = get("parseType")
        if how == "Resource":
            o = self.blank()
            for child in e:
                self.add(o, self.name(child.tag), self.value(child, base, lang))
            return o
        if how == "Collection":
            nodes = [self.description(c, base, lang) for c in e]
            o = (RDF + "nil", "iri", None, None)
            for n in reversed(nodes):
                cell = self.blank()
                self.add(cell, RDF + "first", n)
                self.add(cell, RDF + "rest", o)
                o = cell
            return o
        if how == "Literal":
            return (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), "literal", RDF + "XMLLiteral", None
        if len(e):
            return self.description(e[0], base, lang)
        dt = get("datatype")
        if dt is None and not (e.text or "").strip():
            o = self.blank()
            if self.attributes(e, o, lang):
                return o
        return e.text or "", "literal", None if dt == XSD + "string" else dt, None if dt else lang


def parse(data: bytes, extension: str, base: str = "", scope: str = "", graph: str | None = None) -> Iterator[Quad]:
    if extension in ("rdf", "xml"):
        return iter(RdfXml(data, base, scope, graph).parse())
    return iter(Turtle(data.decode("utf-8"), base, scope, graph).parse())
