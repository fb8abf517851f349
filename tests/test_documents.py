"""JSON sources, the store's folders, and notes under a mapping file's settings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph import terms
from quillgraph.operators import notes, ontology
from quillgraph.sinks.store import Store
from quillgraph.sources import http_pages, json_docs


def _some(rng, depth=3):
    kind = rng.randint(0, 7 if depth else 4)
    if kind == 0:
        return rng.choice([None, True, False, 0, -1, 1.5, 12345678901])
    if kind < 5:
        return "".join(rng.choices('ab"\\\\[]{},: ü日\n', k=rng.randint(0, 9)))
    if kind == 5:
        return [_some(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": _some(rng, depth - 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("step", [1, 2, 7, 64, 100_000])
def test_elements_of_a_stream(step):
    rng = random.Random(step)
    for n in (0, 1, 5, 40):
        docs = [_some(rng) for _ in range(n)]
        text = json.dumps(docs, ensure_ascii=bool(n % 2), indent=rng.choice([None, 1]))
        parts = [text[a : a + step] for a in range(0, len(text), step)]
        assert [json.loads(x) for x in json_docs.elements(iter(parts))] == docs
    for broken in ("[1, 2", '{"a": 1}', '[{"a": ]'):
        with pytest.raises(ValueError):
            list(json_docs.elements(iter([broken])))


def test_arrays_and_lines_keep_their_order(spark, tmp_path):
    docs = [{"data": {"key": f"k{i}", "itemType": "book", "pad": "x" * (i % 50)}} for i in range(700)]
    (tmp_path / "a.json").write_text(json.dumps(docs))
    got = json_docs.read(spark, f"file://{tmp_path}/a.json").orderBy("pos").select("pos", F.expr("variant_get(doc, '$.data.key', 'string')").alias("k")).collect()
    assert [(r.pos, r.k) for r in got] == [(i, f"k{i}") for i in range(700)]
    (tmp_path / "l.json").write_text("".join(json.dumps(x) + "\n\n" for x in docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        seen = []
        for most in ("1kb", "128mb"):  # many tasks, and one
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            seen.append([(r.pos, r.k) for r in json_docs.read(spark, f"file://{tmp_path}/l.json").orderBy("pos").select("pos", F.expr("variant_get(doc, '$.data.key', 'string')").alias("k")).collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == [(i, f"k{i}") for i in range(700)]
    (tmp_path / "none.json").write_text("[]")
    assert json_docs.read(spark, f"file://{tmp_path}/none.json").count() == 0


def _quad(s, g):
    return (s, "iri", "http://p", "x", "literal", None, None, g)


def test_store_rewrites_the_graphs_it_touches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write(terms.from_rows(spark, [_quad("http://a", "http://g1"), _quad("http://b", "http://g2"), _quad("http://c", None)]))
    first = store.folders()
    store.extend(terms.from_rows(spark, [_quad("http://a", "http://g1"), _quad("http://d", "http://g1"), _quad("http://e", "http://g3")]))
    second = store.folders()
    assert {k for k in first if first[k] == second[k]} == {"687474703A2F2F6732", "__default__"} and len(second) == 4
    assert sorted(r.s for r in store.quads().collect()) == ["http://a", "http://b", "http://c", "http://d", "http://e"]
    store.remove(terms.from_rows(spark, [_quad("http://b", "http://g2"), _quad("http://c", None)]))
    assert store.graphs() == ["http://g1", "http://g3"] and store.count() == 3 and store.graph(None).count() == 0
    # what a failed write leaves behind changes nothing, nor does a reader's older version go before a vacuum
    (tmp_path / "store" / "new-left").write_text("{}")
    (tmp_path / "store" / "v=left" / "graph=00").mkdir(parents=True)
    assert store.count() == 3 and store._read(sorted(first.values())).count() == 3
    store.vacuum()
    assert store.count() == 3 and len([x for x in (tmp_path / "store").iterdir() if x.name.startswith("CURRENT-")]) == 1
    assert Store(spark, f"file://{tmp_path}/none").count() == 0


def test_notes_under_a_mapping_file():
    rules = {"Document": {"tags": ["p"]}, "Annotation": {"A": {"regex": ["#\\\\w+#?"], "types": ["T"]}}, "IGNORE": {"tags": ["pre"], "regex": ["#"]}}
    found = notes.parse_note("<p>see #Rome# and <pre>#no</pre> more</p>", "http://n", rules)
    assert [(x["kind"], x["text"]) for x in found] == [("Document", "see Rome and more"), ("Annotation", "Rome")]


def test_context_of_notes(spark):
    df = spark.createDataFrame([("http://n/1", "<p><em>x</em></p>")], "note string, html string")
    context = {"ex": "http://ex.org/", "@vocab": "http://v#", "note": {"@id": "ex:of", "@type": "@id"}, "doc": "within", "made": {"@id": "ex:made", "@type": "xsd:dateTime"}}
    got = {(r.p, r.o_kind, r.o_dt) for r in notes.note_quads(notes.annotations(df), "http://g", {"made": "2024"}, context).collect()}
    assert got >= {("http://ex.org/of", "iri", None), ("http://v#within", "iri", None), ("http://v#text", "literal", None), ("http://ex.org/made", "literal", terms.XSD + "dateTime")}


def test_schema_over_http(spark, monkeypatch):
    monkeypatch.setattr(http_pages, "get", lambda url: json.dumps({"locales": {}, "itemTypes": [{"itemType": "book", "fields": [{"field": "title"}], "creatorTypes": []}]}).encode())
    q = ontology.ontology(ontology.read_schema(spark, "http://x/schema"), "http://v#")
    assert q.where("s = 'http://v#book' AND o = 'http://v#item'").count() == 1
