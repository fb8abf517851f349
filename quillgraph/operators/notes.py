"""HTML notes to annotation graphs, and their links to a knowledge base.

A mapping names, by tags, styles, classes and regular expressions, what counts as a document,
annotation, locator, structure or quotation. A note is parsed in one pass over its HTML; Python is
needed for the HTML alone. What the patterns under IGNORE match is left out of the texts. The nodes' identity and layout are this engine's own: a node is named by
its note, its rule and its number in the note.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..functions.iri import safe_iri
from .entities import best_match

NOTES = "https://semantic-html.org/vocab#"
#: The usual rules, by their usual names; a mapping of the same form replaces them.
MAPPING = {
    "Document": {"tags": ["p"], "types": ["Doc"]},
    "Annotation": {
        "Concept": {"tags": ["em"], "styles": ["font-style:italic"], "types": ["Annotation", "Concept"]},
        "Entity": {"tags": ["strong"], "types": ["Annotation", "Entity"]},
        "Entity2": {"regex": [r"#\w+#?"], "types": ["Annotation", "Entity"]},
        "Reference1": {"tags": ["u"], "types": ["Reference"]},
        "Reference2": {"tags": ["span"], "class": "citation", "types": ["Reference"]},
    },
    "Locator": {"tags": ["code"], "types": ["Page-Locator"]},
    "Structure": {"tags": ["h1", "h2", "h3"], "types": ["Structure"]},
    "Quotation": {"tags": ["blockquote"], "types": ["Quotation"]},
    "IGNORE": {"tags": ["pre", "img"]},
}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _pattern(text: str) -> str:
    """A rule's regular expression; a doubly escaped one, as mapping files have them, loses one escape."""
    return text.replace("\\\\", "\\")


def _rules(mapping: dict) -> list[tuple[str, dict]]:
    out = []
    for kind in ("Document", "Locator", "Structure", "Quotation"):
        if isinstance(mapping.get(kind), dict):
            out.append((kind, mapping[kind]))
    return out + [("Annotation", r) for r in (mapping.get("Annotation") or {}).values()]


def _applies(rule: dict, tag: str, attributes: dict) -> bool:
    tags, css, styles = rule.get("tags") or [], rule.get("class"), rule.get("styles") or []
    if css and css not in (attributes.get("class") or "").split():
        return False
    if tag in tags or not styles:
        return tag in tags
    style = re.sub(r"\s", "", attributes.get("style") or "").lower()
    return any(re.sub(r"\s", "", s).lower() in style for s in styles)


class _Note(HTMLParser):
    def __init__(self, rules, ignored):
        super().__init__(convert_charrefs=True)
        self.rules, self.ignored, self.open, self.found, self.skip = rules, ignored, [], [], 0
        self.levels: list[int] = []  # open headings by number in found

    def handle_starttag(self, tag, attrs):
        if tag in self.ignored:
            self.skip += tag not in _VOID
            return
        if tag in _VOID:
            return
        attributes = dict(attrs)
        mine = []
        for kind, rule in self.rules:
            if rule.get("tags") or rule.get("styles") or rule.get("class"):
                if not self.skip and _applies(rule, tag, attributes):
                    mine.append(len(self.found))
                    level = int(tag[1]) if kind == "Structure" and re.fullmatch(r"h[1-6]", tag) else None
                    self.found.append({"kind": kind, "types": rule.get("types") or [kind], "text": [], "level": level, "doc": self._last("Document"), "structure": None})
                    if kind == "Structure":
                        while self.levels and (self.found[self.levels[-1]]["level"] or 0) >= (level or 1):
                            self.levels.pop()
                        self.found[-1]["structure"] = self.levels[-1] if self.levels else None
                        self.levels.append(len(self.found) - 1)
                    else:
                        self.found[-1]["structure"] = self.levels[-1] if self.levels else None
        self.open.append((tag, mine))

    def _last(self, kind: str) -> int | None:
        for _, mine in reversed(self.open):
            for i in reversed(mine):
                if self.found[i]["kind"] == kind:
                    return i
        return None

    def handle_endtag(self, tag):
        if tag in self.ignored:
            self.skip = max(0, self.skip - (tag not in _VOID))
            return
        if any(t == tag for t, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.skip:
            return
        for _, mine in self.open:
            for i in mine:
                self.found[i]["text"].append(data)
        for kind, rule in self.rules:
            for pattern in rule.get("regex") or []:
                for m in re.finditer(_pattern(pattern), data):
                    self.found.append({"kind": kind, "types": rule.get("types") or [kind], "text": [m.group()], "level": None, "doc": self._last("Document"), "structure": self.levels[-1] if self.levels else None})


def parse_note(text: str, note: str, mapping: dict = MAPPING) -> list[dict]:
    """Annotations of a note: ``id``, ``kind``, ``types``, ``text``, ``doc``, ``structure``, ``locator``, ``level``."""
    ignored = mapping.get("IGNORE") or {}
    parser = _Note(_rules(mapping), frozenset(ignored.get("tags") or []))
    parser.feed(html.unescape(text))
    parser.close()
    out = []
    for n, x in enumerate(parser.found):
        text = "".join(x["text"])
        for pattern in ignored.get("regex") or []:
            text = re.sub(_pattern(pattern), "", text)
        out.append({"id": f"{note}#{uuid.uuid5(uuid.NAMESPACE_URL, f'{note}/{x['kind']}/{n}')}", "kind": x["kind"], "types": x["types"], "text": " ".join(text.split()), "level": x["level"], "doc": x["doc"], "structure": x["structure"], "locator": None})
    last = None
    for i in range(len(out) - 1, -1, -1):  # an annotation's locator is the next one in its document
        if out[i]["kind"] == "Locator":
            last = i
        elif out[i]["kind"] in ("Annotation", "Quotation") and last is not None and out[last]["doc"] == out[i]["doc"]:
            out[i]["locator"] = last
    for x in out:
        for link in ("doc", "structure", "locator"):
            x[link] = out[x[link]]["id"] if x[link] is not None else None
    return out


_SCHEMA = "note string, id string, kind string, types array<string>, text string, level int, doc string, structure string, locator string"
_LAYOUT = "note string, kind string, text string, inside string, locator string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
#: Notes whose rows are held at once.
_AT_ONCE = 500


def _parsed(notes: DataFrame, schema: str, rows: Callable[[str, str], list[dict]]) -> DataFrame:
    """What ``rows`` gives for the note and the HTML of each row of ``notes`` (note, html)."""
    names, types = zip(*(x.split() for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                found = [r for n, h in zip(part.column("note").to_pylist(), part.column("html").to_pylist()) if h for r in rows(n, h)]
                yield pa.record_batch([pa.array([r[k] for r in found], _TYPES[t]) for k, t in zip(names, types)], names=list(names))

    return notes.select("note", "html").mapInArrow(run, schema)


def annotations(notes: DataFrame, mapping: dict = MAPPING, parser: Callable[[str, str, dict], list[dict]] = parse_note) -> DataFrame:
    """A row an annotation of ``notes`` (note, html). ``parser``: another with the same result."""
    return _parsed(notes, _SCHEMA, lambda n, h: [{"note": n, **x} for x in parser(h, n, mapping)])


def layout(notes: DataFrame, mapping: dict = MAPPING, parser: Callable[[str, str, dict], list[dict]] = parse_note) -> DataFrame:
    """The annotations of ``notes`` with the texts of their structure (``inside``) and locator.

    Links never leave a note, so the pass that parses it resolves them, without a join on names.
    """

    def rows(n: str, h: str) -> list[dict]:
        found = parser(h, n, mapping)
        text = {x["id"]: x["text"] for x in found}
        return [{"note": n, "kind": x["kind"], "text": x["text"], "inside": text.get(x["structure"]), "locator": text.get(x["locator"])} for x in found]

    return _parsed(notes, _LAYOUT, rows)


def in_context(key: str, context: dict) -> str:
    """The IRI of a key of a note's annotations under a mapping's ``@context``."""
    given = context.get(key)
    name = given.get("@id", key) if isinstance(given, dict) else given or key
    prefix, colon, rest = name.partition(":")
    if not colon:
        return context.get("@vocab", NOTES) + name
    return context[prefix] + rest if isinstance(context.get(prefix), str) and not rest.startswith("//") else name


def note_quads(found: DataFrame, graph: str, metadata: dict | None = None, context: dict | None = None) -> DataFrame:
    """Quads of annotations in the note vocabulary, ``metadata`` on each.

    ``context``: of a mapping; its names replace those of the vocabulary.
    """
    s = F.col("id")
    types = found.select("id", F.explode("types").alias("t"))
    renamed = {key: in_context(old, context) for key, old in (("inNote", "note"), ("inDoc", "doc"), ("inStructure", "structure"), ("hasLocator", "locator")) if old in context} if context else {}
    vocab = (context or {}).get("@vocab", NOTES)
    n = lambda name: renamed.get(name, vocab + name)
    link = lambda name, column: terms.quads(found, s, n(name), F.when(F.col(column).isNotNull(), terms.iri(F.col(column))), graph)
    out = [
        terms.quads(types, F.col("id"), terms.TYPE, terms.iri(F.concat(F.lit(vocab), F.replace("t", F.lit(" "), F.lit("-")))), graph),
        terms.quads(found, s, n("text"), terms.literal(F.col("text")), graph),
        link("inNote", "note"),
        link("inDoc", "doc"),
        link("inStructure", "structure"),
        link("hasLocator", "locator"),
        terms.quads(found, s, "http://purl.org/spar/doco/hasLevel", F.when(F.col("level").isNotNull(), terms.literal(F.col("level").cast("string"), terms.XSD + "int")), graph),
    ]
    for key, value in (metadata or {}).items():
        given = (context or {}).get(key)
        datatype = given.get("@type") if isinstance(given, dict) else None
        p = in_context(key, context) if context and key in context else key if key.startswith("http") else n(key)
        value = terms.iri(str(value)) if datatype == "@id" else terms.literal(str(value), datatype.replace("xsd:", terms.XSD) if datatype else None)
        out.append(terms.quads(found, s, p, value, graph))
    return terms.union(*out)


def select_notes(quads: DataFrame, predicate: str, graph: str | None = None) -> DataFrame:
    """``note``, ``html`` of the literals of a predicate."""
    out = quads.where((F.col("p") == predicate) & (F.col("o_kind") == "literal"))
    if graph is not None:
        out = out.where(F.col("g") == graph)
    return out.select(F.col("s").alias("note"), F.col("o").alias("html"))


def notes_by_query(solutions: DataFrame) -> DataFrame:
    """Notes from a SELECT: its first variable is the note, its second the HTML."""
    a, b = solutions.columns[:2]
    return solutions.select(F.col(a)["v"].alias("note"), F.col(b)["v"].alias("html"))


def link_entities(note_graph: DataFrame, store: DataFrame, rules: list[dict], kb_default: str, graph: str, threshold: float = 90) -> DataFrame:
    """Quads that link note entities to a knowledge base.

    A rule names ``domainTypes``, ``domainProperty``, ``rangeType``, ``targetProperty``, ``mapProperty``
    and, optionally, ``knowledgeBaseGraph``. A value that matches a label of the range type links the
    note's node to it; one without a match makes a new node in the named graph.
    """
    out = []
    for rule in rules:
        kb = rule.get("knowledgeBaseGraph") or kb_default
        one = lambda k: rule[k] if isinstance(rule[k], list) else [rule[k]]
        typed = note_graph.where((F.col("p") == terms.TYPE) & F.col("o").isin(*one("domainTypes"))).select("s").distinct()
        values = note_graph.where((F.col("p") == rule["domainProperty"]) & (F.col("o_kind") == "literal")).join(typed, "s", "left_semi").select("s", F.col("o").alias("label"))
        ranged = store.where((F.col("p") == terms.TYPE) & (F.col("o") == rule["rangeType"]) & (F.col("g") == kb)).select(F.col("s").alias("node"))
        labels = store.where((F.col("p") == rule["targetProperty"]) & (F.col("g") == kb) & (F.col("o_kind") == "literal")).select(F.col("s").alias("node"), F.col("o").alias("label")).join(ranged, "node", "left_semi")
        best = best_match(values.withColumn("kb", F.lit(kb)), labels.withColumn("kb", F.lit(kb)), ["kb"], threshold).select(F.col("label").alias("low"), "node")
        found = values.withColumn("low", F.lower("label")).join(best, "low", "left")
        # labels that differ only in case make one new node, named after the least spelling
        fresh = found.where("node IS NULL").groupBy("low").agg(F.min("label").alias("spelling"))
        minted = F.concat(F.lit(f"{kb}/semantic_html/"), terms.uuid5(terms.entity_namespace(kb), F.col("spelling")))
        fresh = fresh.withColumn("new", minted)
        if not rule.get("knowledgeBaseGraph"):
            fresh = fresh.where(F.lit(False))
        every = found.join(fresh, "low", "left").withColumn("kb_node", F.coalesce("node", "new")).where("kb_node IS NOT NULL")
        known = store.where((F.col("p") == terms.ALT_LABEL) & (F.col("g") == kb)).select(F.col("s").alias("kb_node"), F.lower("o").alias("low"))
        alts = every.groupBy("kb_node", "low").agg(F.min("label").alias("label")).join(known, ["kb_node", "low"], "left_anti")
        out += [
            terms.quads(every, F.col("s"), rule["mapProperty"], terms.iri(F.col("kb_node")), graph),
            terms.quads(fresh, F.col("new"), terms.TYPE, terms.iri(safe_iri(F.lit(rule["rangeType"]))), kb),
            terms.quads(fresh, F.col("new"), terms.LABEL, terms.literal(F.col("spelling")), kb),
            terms.quads(alts, F.col("kb_node"), terms.ALT_LABEL, terms.literal(F.col("label")), kb),
        ]
    return terms.as_set(terms.union(*out)) if out else terms.empty(note_graph.sparkSession)
