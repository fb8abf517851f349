"""The visual builder's JSON queries, its property model, widgets and facets.

A query is a tree: a branch has a ``line`` (subject, predicate, object, their types, chosen values) and
``children`` whose subjects are the line's object. A predicate of the builder stands for a property
path; the model says which.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms
from . import algebra as A
from . import paths as P
from .expressions import Call, Constant, Variable

#: Rows of a query that names no limit.
LIMIT = 1000


@dataclass
class Property:
    """``path``: nested as for ``paths.from_shape``. ``widget``: search, list, autocomplete, year, number or none."""

    path: object
    widget: str = "none"
    value: str = "text"
    target: str | None = None
    optional: bool = True


@dataclass
class Model:
    properties: dict[str, Property] = field(default_factory=dict)
    #: Class of each builder class; others stand for themselves.
    classes: dict[str, str] = field(default_factory=dict)

    def path(self, predicate: str):
        known = self.properties.get(predicate)
        return P.from_shape(known.path) if known else P.Link(predicate)


def bibliographic_model(vocab: str, notes: str = "https://semantic-html.org/vocab#") -> Model:
    """The properties of the bibliographic graph, and of the note layer."""
    v = lambda name: vocab + name
    n = lambda name: notes + name
    inv = lambda name: ("inverse", v(name))
    rows = {
        "created_by": (v("creators"), "none", "link", "creatorRole"),
        "has_tag": (v("tags"), "list", "link", "tag"),
        "in_collections": (v("collections"), "none", "link", "collection"),
        "has_parent_item": (v("parentItem"), "none", "link", "item"),
        "tag_of": (inv("tags"), "none", "link", "item"),
        "collection_of": (inv("collections"), "none", "link", "item"),
        "library_of": (inv("inLibrary"), "none", "link", "item"),
        "created": (inv("creators"), "none", "link", "item"),
        "taken_by": (v("hasCreator"), "autocomplete", "link", "person"),
        "has_creator": ([v("creators"), v("hasCreator")], "autocomplete", "link", "person"),
        "is_creator_of": ([inv("hasCreator"), inv("creators")], "autocomplete", "link", "item"),
        "has_type": (v("itemType"), "list", "text", None),
        "acted_as": (inv("hasCreator"), "autocomplete", "link", "creatorRole"),
        "is_parent_item_of": (inv("parentItem"), "autocomplete", "link", "item"),
        "in_collection": (v("parentCollection"), "none", "link", "collection"),
        "parent_collection_of": (inv("parentCollection"), "none", "link", "collection"),
        "place_of": (inv("place"), "autocomplete", "link", "item"),
        "publisher_of": (inv("publisher"), "autocomplete", "link", "item"),
        "in_library": (v("inLibrary"), "search", "link", "library"),
        "called": (terms.LABEL, "search", "text", None),
        "title": (v("title"), "search", "text", None),
        "short_title": (v("shortTitle"), "search", "text", None),
        "date": (v("date"), "year", "date", None),
        "note_html": (v("note"), "none", "text", None),
        "url": (v("url"), "none", "link", "Link"),
        **{x: (v(x), "number", "number", None) for x in ("number", "versionNumber", "numPages", "seriesNumber", "numberOfVolumes", "volume")},
        **{x: (v(x), "none", "text", None) for x in ("bookTitle", "firstName", "lastName", "name", "tag", "series")},
        "has_locator": (n("hasLocator"), "autocomplete", "link", "locator"),
        "in_note": (n("inNote"), "autocomplete", "link", "note"),
        "in_structure": (("oneOrMore", n("inStructure")), "autocomplete", "link", "structure"),
        "in_doc": (("oneOrMore", n("inDoc")), "autocomplete", "link", "doc"),
        "identifies_as": (("oneOrMore", ("alternative", [terms.OWL + "sameAs", ("inverse", terms.OWL + "sameAs")])), "autocomplete", "link", "Link"),
        "plain_text": (n("text"), "search", "text", None),
    }
    return Model({vocab + k: Property(*x, optional=k != "called") for k, x in rows.items()})


def _end(x: str):
    return A.Var(x[1:]) if x.startswith("?") else A.Term(x)


def _term(value: dict) -> A.Term:
    kind = {"uri": "iri", "iri": "iri", "bnode": "bnode", "literal": "literal"}[value["type"]]
    return A.Term(value["value"], kind, value.get("datatype"), value.get("xml:lang"))


def _criteria(name: str, line: dict) -> list:
    """Filters of a widget: ``search`` (text or regex), ``years`` (from, to), ``range`` (from, to)."""
    var, out = Variable(name), []
    text = lambda s: Constant(A.Term(s, "literal"))
    if line.get("search"):
        out.append(Call("CONTAINS", [Call("LCASE", [Call("STR", [var])]), text(line["search"].lower())]))
    if line.get("regex"):
        out.append(Call("REGEX", [Call("STR", [var]), text(line["regex"]), text("i")]))
    if line.get("years"):
        year = Call(terms.XSD + "integer", [Call("SUBSTR", [Call("STR", [var]), Constant(A.Term("1", "literal", terms.XSD + "integer")), Constant(A.Term("4", "literal", terms.XSD + "integer"))])])
        out += _between(year, line["years"], "integer")
    if line.get("range"):
        out += _between(Call(terms.XSD + "double", [var]), line["range"], "double")
    return out


def _between(e, bounds, kind: str) -> list:
    low, high = bounds
    one = lambda x: Constant(A.Term(str(x), "literal", terms.XSD + kind))
    return ([Call(">=", [e, one(low)])] if low is not None else []) + ([Call("<=", [e, one(high)])] if high is not None else [])


def compile_query(q: dict, model: Model | None = None, limit: int | None = LIMIT):
    """The algebra of a query of the visual builder."""
    model = model or Model()

    def branch(b: dict, out):
        line = b["line"]
        s, o = _end(line["s"]), _end(line["o"])
        triples = []
        for node, kind in ((s, line.get("sType")), (o, line.get("oType"))):
            if kind and isinstance(node, A.Var) and kind not in ("literal",):
                triples.append(A.Triple(node, A.Term(terms.TYPE), A.Term(model.classes.get(kind, kind))))
        known = model.properties.get(line["p"])
        if known and known.value != "link":
            triples = triples[:1] if line.get("sType") else []  # literals have no type
        path = model.path(line["p"])
        triples.append(A.Triple(s, A.Term(path.iri) if isinstance(path, P.Link) else path, o))
        node = A.Bgp(triples)
        if line.get("values"):
            node = A.Join(A.Values([o.name], [[_term(v["rdfTerm"])] for v in line["values"]]), node)
        for c in _criteria(o.name, line) if isinstance(o, A.Var) else ():
            node = A.Filter(c, node)
        for child in b.get("children") or ():
            node = branch(child, node)
        if out is None:
            return node
        return (A.LeftJoin if b.get("optional") else A.Join)(out, node)

    pattern = None
    for b in q["branches"]:
        pattern = branch(b, pattern)
    names = [x.lstrip("?") if isinstance(x, str) else x["value"] for x in q["variables"]]
    if q.get("order"):
        pattern = A.OrderBy([(Variable(names[0]), q["order"] != "desc")], pattern)
    pattern = A.Project(names, pattern)
    if q.get("distinct"):
        pattern = A.Distinct(pattern) if not q.get("order") else A.OrderBy([(Variable(names[0]), q["order"] != "desc")], A.Distinct(pattern))
    return A.Slice(0, limit, pattern) if limit is not None else pattern


def run(data: A.Dataset, q: dict, model: Model | None = None, limit: int | None = LIMIT) -> DataFrame:
    return A.evaluate(data, compile_query(q, model, limit))


def facets(data: A.Dataset, predicate: str, model: Model | None = None, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Values of a property with the number of subjects that have each, most frequent first; for list and
    autocomplete widgets. ``value``, ``label`` (rdfs:label, or the value), ``n``."""
    path = (model or Model()).path(predicate)
    found = P.pairs(data.quads, path, apart=data.apart)
    counts = found.distinct().groupBy(F.col("b.v").alias("value"), F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"))
    labels = data.quads.where(F.col("p") == terms.LABEL).groupBy(F.col("s").alias("value")).agg(F.min("o").alias("label"))
    out = counts.join(labels, "value", "left").select("value", F.coalesce("label", "value").alias("label"), "n")
    if contains:
        out = out.where(F.contains(F.lower("label"), F.lit(contains.lower())))
    out = out.orderBy(F.desc("n"), "value")
    return out if limit is None else out.limit(limit)
