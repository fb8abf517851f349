import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph import terms
from quillgraph.operators import notes, ontology
from quillgraph.plans import algebra, paths, sparql, visual
from quillgraph.sinks import csv_pivot, rdf_export
from quillgraph.sinks.store import Store, pattern
from quillgraph.sources import csv_quads, http_pages, rdf_files, rdf_parser
from quillgraph.streaming import refresh

N = "http://n.org/"


def quad(s, p, o, g=None, kind="iri", dt=None, lang=None):
    return (N + s, "iri", N + p, N + o if kind == "iri" else o, kind, dt, lang, g)


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        quad("a", "knows", "b", "g1"), quad("b", "knows", "c", "g1"), quad("c", "knows", "a", "g2"), quad("d", "knows", "d", "g2"),
        quad("a", "name", "Ann", "g1", "literal"), quad("b", "name", "Bob", "g1", "literal", None, "en"), quad("c", "age", "7", "g2", "literal", terms.XSD + "integer"),
        quad("a", "age", "30", "g1", "literal", terms.XSD + "integer"), quad("a", "knows", "b", "g2"),
    ]
    return algebra.Dataset(terms.from_rows(spark, rows))


def run(graph, text):
    rows = sparql.query(graph, f"PREFIX n: <{N}> PREFIX xsd: <{terms.XSD}> " + text).collect()
    return sorted(tuple(None if x is None else (x.v.removeprefix(N) if hasattr(x, "v") else x) for x in r) for r in rows)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT ?x ?y { ?x n:knows ?y }", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")]),  # graphs are merged as sets
        ("SELECT ?x { ?x n:knows ?x }", [("d",)]),
        ("SELECT ?x ?n { ?x n:knows ?y OPTIONAL { ?x n:name ?n } }", [("a", "Ann"), ("b", "Bob"), ("c", None), ("d", None)]),
        ("SELECT ?x { ?x n:age ?a FILTER(?a > 10) }", [("a",)]),
        ("SELECT ?x { ?x n:name ?n FILTER(LANG(?n) = 'en') }", [("b",)]),
        ("SELECT ?x { ?x n:knows ?y FILTER NOT EXISTS { ?x n:name ?n } }", [("c",), ("d",)]),
        ("SELECT ?x { ?x n:knows ?y MINUS { ?x n:age ?a } }", [("b",), ("d",)]),
        ("SELECT ?x { ?x n:knows ?y MINUS { ?z n:age ?a } }", [("a",), ("b",), ("c",), ("d",)]),
        ("SELECT ?y { n:a n:knows+ ?y }", [("a",), ("b",), ("c",)]),
        ("SELECT ?y { n:x n:knows* ?y }", [("x",)]),
        ("SELECT ?y { n:a n:knows? ?y }", [("a",), ("b",)]),
        ("SELECT ?x { ?x n:knows/n:knows n:a }", [("b",)]),
        ("SELECT ?x ?y { ?x ^n:knows ?y FILTER(?x = n:c) }", [("c", "b")]),
        ("SELECT ?o { n:a !(n:knows|n:age) ?o }", [("Ann",)]),
        ("SELECT ?g { GRAPH ?g { n:c ?p ?o } }", [("g2",), ("g2",)]),
        ("SELECT ?g ?y { GRAPH ?g { n:a n:knows+ ?y } }", [("g1", "b"), ("g1", "c"), ("g2", "b")]),
        ("SELECT ?g ?y { GRAPH ?g { n:b n:knows* ?y } }", [("g1", "b"), ("g1", "c"), ("g2", "b")]),
        ("SELECT ?g ?x { GRAPH ?g { ?x n:knows/n:knows n:d } }", [("g2", "d")]),
        ("SELECT ?x { GRAPH <g1> { ?x n:knows ?y } }", [("a",), ("b",)]),
        ("SELECT ?x ?v { VALUES (?x ?v) { (n:a 1) (UNDEF 2) } ?x n:name ?n }", [("a", "1"), ("a", "2"), ("b", "2")]),
        ("SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) (COUNT(*) AS ?n) { ?x n:age ?a }", [("37", "18.5", "2")]),
        ("SELECT ?x (IF(?a > 10, 'old', 'young') AS ?k) { ?x n:age ?a }", [("a", "old"), ("c", "young")]),
        ("SELECT ?x { { SELECT ?x { ?x n:age ?a } ORDER BY DESC(?a) LIMIT 1 } ?x n:name ?n }", [("a",)]),
        ("SELECT DISTINCT ?p { ?s ?p ?o } ORDER BY ?p LIMIT 2", [("age",), ("knows",)]),
        ("ASK { n:a n:knows n:b }", [(True,)]),
        ("ASK { n:b n:knows n:a }", [(False,)]),
        ("SELECT ?x { ?x n:name ?n FILTER REGEX(?n, '^a', 'i') }", [("a",)]),
        ("SELECT ?x { ?x n:age ?a FILTER(?a IN (7, 8)) }", [("c",)]),
        ("SELECT ?x ?l { ?x n:name ?n BIND(STRLEN(?n) + 1 AS ?l) }", [("a", "4"), ("b", "4")]),
        ("SELECT ?x { ?x n:name ?n FILTER(?n > 5) }", []),  # an error is not a match
    ],
)
def test_sparql(graph, text, expected):
    assert run(graph, text) == sorted(expected, key=lambda t: tuple(t)) if None not in sum(map(tuple, expected), ()) else run_unsorted(graph, text) == set(expected)


def run_unsorted(graph, text):
    rows = sparql.query(graph, f"PREFIX n: <{N}> " + text).collect()
    return {tuple(None if x is None else x.v.removeprefix(N) for x in r) for r in rows}


def test_construct_describe_and_errors(graph):
    made = sparql.query(graph, f"PREFIX n: <{N}> CONSTRUCT {{ ?y n:knownBy ?x }} WHERE {{ ?x n:knows ?y }}")
    assert {(r.s, r.o) for r in made.collect()} == {(N + b, N + a) for a, b in (("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"))}
    assert sparql.query(graph, f"DESCRIBE <{N}c>").count() == 2
    for bad in ("SELECT", "SELECT ?x { ?x n:y ?z }", "SELECT ?x { SERVICE <x> { ?a ?b ?c } }", "DROP ALL"):
        with pytest.raises(ValueError):
            sparql.parse(bad)


def test_visual_examples(graph, spark):
    q = {"distinct": True, "variables": ["Person_1"], "order": None, "branches": [{"line": {"s": "?Person_1", "p": N + "knows", "o": "?Person_2", "sType": None, "oType": None, "values": []}, "children": [{"line": {"s": "?Person_2", "p": N + "knows", "o": "?Person_4", "sType": None, "oType": None, "values": [{"label": "A (2)", "rdfTerm": {"type": "uri", "value": N + "a"}}]}, "children": []}]}]}
    assert [r[0] for r in algebra.plain(visual.run(graph, q)).collect()] == [N + "b"]
    line = {"s": "?x", "p": N + "age", "o": "?a", "sType": None, "oType": None, "values": [], "range": [10, None]}
    q = {"distinct": True, "variables": ["x"], "order": "asc", "branches": [{"line": line, "children": []}]}
    model = visual.Model({N + "age": visual.Property(N + "age", "number", "number")})
    assert [r[0] for r in algebra.plain(visual.run(graph, q, model)).collect()] == [N + "a"]
    names = visual.bibliographic_model("http://v#").properties
    assert len(names) > 40 and names["http://v#has_creator"].path == ["http://v#creators", "http://v#hasCreator"]


TURTLE = """@prefix n: <http://n.org/> . @base <http://b.org/x/> .
n:s n:p "a\\"b" , "x"@de , 5 , 1.5 , true , "2020-01-01"^^<http://www.w3.org/2001/XMLSchema#date> ; a n:T .
<rel> n:q [ n:r ( 1 <two> ) ] . _:x n:p _:x . # end
n:s n:long \"\"\"two
lines\"\"\" ."""
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:n="http://n.org/">
<n:T rdf:about="http://n.org/s" n:short="v"><n:p xml:lang="de">x</n:p><n:q rdf:resource="rel"/><n:r rdf:parseType="Resource"><n:i rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</n:i></n:r></n:T></rdf:RDF>"""


def test_parsers():
    t = list(rdf_parser.parse(TURTLE.encode(), "ttl"))
    assert len(t) == 7 + 2 + 4 + 1 + 1
    assert (N + "s", "iri", N + "p", "x", "literal", None, "de", None) in t and any(q[3] == "two\nlines" for q in t) and any(q[3] == "http://b.org/x/two" for q in t)
    assert t == list(rdf_parser.parse(TURTLE.encode(), "ttl"))
    g = list(rdf_parser.parse(b"@prefix n: <http://n.org/> . n:s n:p 1 . n:g { n:s n:p 2 } GRAPH n:h { n:a n:b n:c . }", "trig"))
    assert [q[-1] for q in g] == [None, N + "g", N + "h"]
    x = list(rdf_parser.parse(XML.encode(), "rdf", "http://b.org/"))
    assert len(x) == 6 and (N + "s", "iri", N + "q", "http://b.org/rel", "iri", None, None, None) in x
    with pytest.raises(ValueError):
        list(rdf_parser.parse(b"n:s n:p 1 .", "ttl"))


def test_n_quads(spark, tmp_path):
    lines = ['<http://n.org/s> <http://n.org/p> "a\\"\\u00e9\\n"@de <http://g> .', '_:x <http://n.org/p> "5"^^<http://www.w3.org/2001/XMLSchema#int> .', "# no statement", "", '<http://n.org/s> <http://n.org/p> _:x .']
    (tmp_path / "a.nq").write_text("\n".join(lines))
    rows = rdf_files.read(spark, str(tmp_path / "a.nq"), "nq", graph="http://d").collect()
    assert {(r.o, r.o_lang, r.o_dt, r.g) for r in rows if r.o_kind == "literal"} == {('a"é\n', "de", None, "http://g"), ("5", None, terms.XSD + "int", "http://d")}
    assert next(r.s for r in rows if r.s_kind == "bnode") == next(r.o for r in rows if r.o_kind == "bnode")
    (tmp_path / "b.txt").write_text("skipped")
    (tmp_path / "c.json").write_text("[]")
    quads, found = rdf_files.read_directory(spark, str(tmp_path), "http://b/", "http://d")
    assert quads.count() == 3 and [f.rsplit("/", 1)[1] for f in found] == ["c.json"]
    assert rdf_files.read_directory(spark, str(tmp_path / "none"))[0].count() == 0


@pytest.mark.parametrize("format", ["ttl", "trig", "nt", "nquads", "n3", "xml"])
def test_export_roundtrip(spark, tmp_path, format):
    rows = [quad("s", "p", 'q"\\\n<&é', "http://g", "literal"), quad("s", "p", "x", "http://g", "literal", None, "de"), quad("s", "q", "o", "http://g"), quad("s", "p", "5", "http://g", "literal", terms.XSD + "int"), ("_:b1", "bnode", N + "p", "_:b2", "bnode", None, None, "http://g")]
    path = str(tmp_path / "out")
    rdf_export.write(terms.from_rows(spark, rows), path, format, "http://g", N)
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    if format in ("nt", "nquads"):
        got = [tuple(r) for r in rdf_files.read(spark, path, "nq", graph="http://g").collect()]
    else:
        got = list(rdf_parser.parse(text.encode(), "rdf" if format == "xml" else "trig", graph="http://g"))
    plain = lambda r: tuple(x for i, x in enumerate(r) if not (i in (0, 3) and str(x).startswith("_:")))
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, rows)))


def test_export_scopes(spark):
    q = terms.from_rows(spark, [quad("s", "p", "o", "http://g"), quad("s", "p", "d")])
    assert rdf_export.export(q, "nt")[0].count() == 1  # the default graph alone
    assert rdf_export.export(q, "nquads")[0].count() == 2
    with pytest.raises(ValueError):
        rdf_export.export(q, "pdf")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.count() == 0 and store.graphs() == []
    rows = [quad("s", "p", "o", "http://g/ü?x=1"), quad("s", "p", "o", "http://g/ü?x=1"), quad("s", "p", "o")]
    store.write(terms.from_rows(spark, rows))
    assert store.count() == 2 and store.graphs() == ["http://g/ü?x=1"]
    assert store.graph("http://g/ü?x=1").count() == 1 and store.graph(None).count() == 1
    store.extend(terms.from_rows(spark, [quad("t", "p", "o"), rows[0]]))
    assert store.count() == 3 and pattern(store.quads(), s=N + "t").count() == 1
    store.remove(terms.from_rows(spark, [quad("t", "p", "o")]))
    store.optimize()
    store.vacuum()
    assert store.count() == 2 and store.backup(f"file://{tmp_path}/copy") == 2
    with pytest.raises(ValueError):
        store.backup(f"file://{tmp_path}/store/inner")


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('IRI,http://x/p,http://x/q\nhttp://x/s1,a | b,<http://x/o>\nhttp://x/s2,,c\n,z,\n')
    table = csv_quads.read(spark, str(tmp_path / "t.csv"))
    got = {(r.s, r.p, r.o, r.o_kind) for r in csv_quads.quads(table).collect()}
    assert got == {("http://x/s1", "http://x/p", "a", "literal"), ("http://x/s1", "http://x/p", "b", "literal"), ("http://x/s1", "http://x/q", "http://x/o", "iri"), ("http://x/s2", "http://x/q", "c", "literal")}
    assert "<http://x/o>" in {r.o for r in csv_quads.quads(table, strict=True).collect()}
    wide = csv_pivot.pivot(csv_quads.quads(table)).collect()
    assert [tuple(r) for r in wide] == [("http://x/s1", "a | b", "<http://x/o>"), ("http://x/s2", "", "c")]
    left = csv_pivot.upsert(terms.from_rows(spark, [("http://x/s1", "iri", "http://x/p", "old", "literal", None, None, None)]), table, delete_first=True)
    assert "old" not in {r.o for r in left.collect()} and left.count() == 4


def test_pages():
    calls = []

    def fetch(url, headers=None):
        calls.append(url)
        start = int(url.split("start=")[1].split("&")[0])
        return json.dumps([{"data": {"key": str(i)}} for i in range(start, min(start + 100, 250))]).encode()

    got = list(http_pages.pages("http://h/items", {"tag": "x"}, fetch=fetch, pause=0))
    assert [len(p) for p in got] == [100, 100, 50] and len(calls) == 4 and "tag=x" in calls[0]


def test_http_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            start = int(self.path.split("start=")[1].split("&")[0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"data": {"key": f"k{i}"}} for i in range(start, min(start + 100, 120))]).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    docs = http_pages.read_pages(spark, f"http://127.0.0.1:{server.server_port}/items", {"itemType": "book"}, pause=0, backoff=0.01)
    assert docs.select(F.expr("variant_get(doc, '$.data.key', 'string')")).distinct().count() == 120
    assert all("itemType=book" in p for p in seen)
    server.shutdown()


def test_ontology(spark):
    doc = [({"en": ({"book": "Book"}, {"author": "Author"}, {"title": "Title"}), "de": ({"book": "Buch"}, {}, {})}, [("book", [("title", None), ("bookTitle", "title")], [("author",), ("editor",)]), ("map", [("title", None)], [])])]
    q = ontology.ontology(spark.createDataFrame(doc, ontology.SCHEMA), "http://v#").collect()
    has = {(r.s, r.p, r.o, r.o_lang) for r in q}
    assert ("http://v#book", terms.LABEL, "Buch", "de") in has and ("http://v#bookTitle", terms.OWL + "equivalentProperty", "http://v#title", None) in has
    assert ("http://v#bookTitle", terms.RDFS + "domain", "http://v#book", None) in has
    union = next(r.o for r in q if r.s == "http://v#title" and r.p == terms.RDFS + "domain")
    node = next(r.o for r in q if r.s == union and r.p == terms.OWL + "unionOf")
    members = []
    while node != terms.RDF + "nil":
        members.append(next(r.o for r in q if r.s == node and r.p == terms.RDF + "first"))
        node = next(r.o for r in q if r.s == node and r.p == terms.RDF + "rest")
    assert members == ["http://v#book", "http://v#map"]


HTML = '<h1>T</h1><p>See <strong>London</strong> &amp; <em>tide</em> #wave <code>12</code></p><h2>U</h2><blockquote>q<br>r</blockquote><pre><strong>no</strong></pre><span class="citation">c</span>'


def test_notes(spark):
    found = notes.parse_note(HTML, "http://n/1")
    assert [(x["kind"], x["text"]) for x in found] == [("Structure", "T"), ("Document", "See London & tide #wave 12"), ("Annotation", "London"), ("Annotation", "tide"), ("Annotation", "#wave"), ("Locator", "12"), ("Structure", "U"), ("Quotation", "qr"), ("Annotation", "c")]
    assert found[6]["structure"] == found[0]["id"] and found[7]["structure"] == found[6]["id"] and found[2]["doc"] == found[1]["id"] and found[2]["locator"] == found[5]["id"]
    df = spark.createDataFrame([("http://n/1", HTML), ("http://n/2", ""), ("http://n/3", None), ("http://n/4", "<p>Londen <strong>Londen</strong> <strong>Rome</strong>")], "note string, html string")
    q = notes.note_quads(notes.annotations(df), "http://g")
    kb = terms.from_rows(spark, [("http://k/1", "iri", terms.TYPE, "http://v#place", "iri", None, None, "http://k"), ("http://k/1", "iri", terms.ALT_LABEL, "London", "literal", None, None, "http://k")])
    rule = {"domainTypes": notes.NOTES + "Entity", "domainProperty": notes.NOTES + "text", "rangeType": "http://v#place", "targetProperty": terms.ALT_LABEL, "mapProperty": terms.OWL + "sameAs", "knowledgeBaseGraph": "http://k"}
    links = notes.link_entities(q, kb, [rule], "http://k", "http://g", 80).collect()
    assert {r.o for r in links if r.p == terms.OWL + "sameAs"} >= {"http://k/1"} and "Londen" in {r.o for r in links if r.s == "http://k/1"}
    assert {r.o for r in links if r.p == terms.LABEL} == {"Rome", "#wave"}


def test_refresh_plans(spark, tmp_path):
    assert [refresh.plan(x) for x in (-1, 0, 29, 30)] == ["never", "once", "once", "repeat"]
    done = []
    assert refresh.every(spark, 0, lambda: done.append(1), str(tmp_path / "c")) is None and done == [1]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a": 1}\n{"a": 2}\n')
    rows = []
    refresh.on_new_files(spark, str(tmp_path / "in"), lambda df, epoch: rows.extend(df.collect()), str(tmp_path / "k")).awaitTermination(60)
    assert len(rows) == 2


def test_joins_of_unbound_variables(spark):
    """All joins on variables that either side may leave unbound, against their definition."""
    rng = random.Random(3)
    row = lambda n: [rng.choice([None, "p", "q", "r"]) for _ in range(n)]
    left, right = [[*row(2), f"l{i}"] for i in range(24)], [[*row(2), f"r{i}"] for i in range(6)]

    def solutions(rows, names):
        term = lambda x: None if x is None else (x, "iri", None, None)
        df = spark.createDataFrame([tuple(map(term, r)) for r in rows], ", ".join(f"{n} {algebra.TERM}" for n in names))
        return algebra.Solutions(df, {"x", "y"})

    def plain(out):
        return sorted(repr(tuple(None if r[n] is None else r[n].v for n in sorted(out.names))) for r in out.df.collect())

    a, b = solutions(left, ["x", "y", "l"]), solutions(right, ["x", "y", "r"])
    fit = lambda s, t: all(i is None or j is None or i == j for i, j in zip(s[:2], t[:2]))
    both = lambda s, t: any(i is not None and j is not None for i, j in zip(s[:2], t[:2]))
    met = [(s[2], t[2], s[0] or t[0], s[1] or t[1]) for s in left for t in right if fit(s, t)]
    alone = [(s[2], None, s[0], s[1]) for s in left if not any(fit(s, t) for t in right)]
    compiler = algebra.Compiler(algebra.Dataset(terms.empty(spark)))
    assert plain(compiler._joined(a, b)) == sorted(map(repr, met))
    assert plain(compiler._joined(a, b, "left")) == sorted(map(repr, met + alone))
    kept = lambda wanted: sorted(repr((s[2], s[0], s[1])) for s in left if wanted(s))
    assert plain(compiler._joined(a, b, "left_semi")) == kept(lambda s: any(fit(s, t) for t in right))
    assert plain(compiler._joined(a, b, "left_anti")) == kept(lambda s: not any(fit(s, t) for t in right))
    assert plain(compiler._joined(a, b, "left_anti", overlap=True)) == kept(lambda s: not any(fit(s, t) and both(s, t) for t in right))


def test_closure_of_a_long_chain(spark):
    """More rounds than tables of known pairs."""
    node = lambda k: (f"{N}{k}", "iri", None, None)
    edges = spark.createDataFrame([(node(k), node(k + 1)) for k in range(11)] + [(node(11), node(9))], f"a {algebra.TERM}, b {algebra.TERM}")
    got = sorted((int(r.a.v.removeprefix(N)), int(r.b.v.removeprefix(N))) for r in paths.closure(edges).collect())
    assert got == [(i, j) for i in range(12) for j in range(12) if i < j or min(i, j) >= 9]
