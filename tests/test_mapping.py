import uuid

import pytest
from pyspark.sql import functions as F

from quillgraph import pipeline, terms
from quillgraph.config import Context, Library, load_config, set_defaults
from quillgraph.functions.dates import date_literal, parse_residue
from quillgraph.functions.iri import file_name, safe_iri
from quillgraph.functions.text import language_code
from quillgraph.sources import json_docs

V = "http://x.org/v#"
ITEMS = [
    {
        "library": {"type": "group", "id": 1, "name": "Demo", "links": {"alternate": {"href": "https://ex.org/groups/demo"}}},
        "data": {
            "key": "AAAA1111", "itemType": "book", "title": "On Tides", "date": "12 March 1687",
            "creators": [{"creatorType": "author", "firstName": "Ada", "lastName": "Byron"}, {"creatorType": "editor", "name": "Royal Society"}],
            "place": "London; Paris", "publisher": "Printer", "numPages": "120", "volume": "II", "tags": [{"tag": "tides"}, {"tag": "Tides", "type": 1}],
            "collections": ["CCCC1111"], "relations": {"owl:sameAs": "http://example.org/x"}, "dateAdded": "2024-01-02T03:04:05Z", "archived": True, "deleted": False, "version": 0,
        },
    },
    {"data": {"key": "BBBB2222", "itemType": "book", "title": "Über Ebbe", "language": "german", "date": "1450", "creators": [{"creatorType": "author", "firstName": "Ada", "lastName": "Byrón"}], "place": "london"}},
    {"data": {"key": "NNNN3333", "itemType": "note", "parentItem": "AAAA1111", "note": "<p>x</p>"}},
]
COLLECTIONS = [{"data": {"key": "CCCC1111", "name": "Oceans", "parentCollection": False}}, {"data": {"key": "DDDD2222", "name": "Tides", "parentCollection": "CCCC1111"}}]
G = "https://ex.org/groups/1"
KB = "https://ex.org/entities"


def library(**mapping) -> Library:
    return Library(name="Demo", base_url=G, knowledge_base_graph=KB, library_type="groups", library_id="1", map={"item_type": ["_item", "itemType"], "collection_type": ["_collection"], "named_library": "inLibrary"} | mapping)


def build(spark, strict, **mapping):
    docs = (json_docs.from_objects(spark, ITEMS), json_docs.from_objects(spark, COLLECTIONS), terms.empty(spark))
    rows = pipeline.build(spark, [library(**mapping)], Context(vocab=V), "2024-01-01T00:00:00+00:00", strict, sources={"Demo": docs}).collect()
    return {(r.s.removeprefix(G + "/"), r.p.removeprefix(V), r.o, r.o_dt, r.o_lang, r.g) for r in rows}, rows


def test_intended(spark):
    q, rows = build(spark, False)
    assert len(q) == len(rows)
    item = "items/AAAA1111"
    assert (item, "date", "1687", terms.XSD + "gYear", None, G) in q
    assert (item, "numPages", "120", terms.XSD + "int", None, G) in q
    assert (item, "volume", "II", None, None, G) in q
    assert (item, "dateAdded", "2024-01-02T03:04:05Z", terms.XSD + "dateTime", None, G) in q
    assert (item, "archived", "True", None, None, G) in q
    assert not any(s == item and p in ("deleted", "version") for s, p, *_ in q)  # falsy values give nothing
    assert (item, terms.LABEL, "Byron: On Tides (12 March 1687)", None, None, G) in q
    assert ("items/NNNN3333", terms.LABEL, "NO CREATOR: NO TITLE (NO DATE)", None, None, G) in q
    assert {o for s, p, o, *_ in q if s == item and p == terms.TYPE} == {V + "item", V + "book"}
    assert ("items/BBBB2222", "title", "Über Ebbe", None, "de", G) in q
    assert ("items/BBBB2222", "language", "de", None, None, G) in q
    assert ("items/NNNN3333", "parentItem", G + "/items/AAAA1111", None, None, G) in q
    assert (item, "inLibrary", "https://ex.org/groups/demo", None, None, G) in q
    assert ("collections/DDDD2222", "parentCollection", G + "/collections/CCCC1111", None, None, G) in q
    assert not any(s == "collections/CCCC1111" and p == "parentCollection" for s, p, *_ in q)
    # places: two entities, the third mention reuses London without a new label
    ns = uuid.uuid5(uuid.NAMESPACE_URL, KB)
    london, paris = (f"{KB}/place/{uuid.uuid5(ns, x)}" for x in ("London", "Paris"))
    assert {(s, o) for s, p, o, *_ in q if p == "place"} == {(item, london), (item, paris), ("items/BBBB2222", london)}
    assert {o for s, p, o, *_ in q if s == london and p == terms.ALT_LABEL} == {"London"}
    # tags differ by case; fields come from the first mention
    assert len({o for s, p, o, *_ in q if p == "tags"}) == 2
    # a similar name is the same person with two labels; every mention has its role
    person = f"{KB}/person/{uuid.uuid5(ns, 'Byron, Ada')}"
    assert {o for s, p, o, *_ in q if s == person and p == terms.ALT_LABEL} == {"Byron, Ada", "Byrón, Ada"}
    roles = {s for s, p, o, *_ in q if p == "hasCreator" and o == person}
    assert len(roles) == 2 and all((s, terms.LABEL, "author", None, None, G) in q for s in roles)
    # nested objects become blank nodes
    node = next(o for s, p, o, *_ in q if s == item and p == "relations")
    assert any(s == node and p.endswith("owl:sameAs") and o == "http://example.org/x" for s, p, o, *_ in q)


def test_strict(spark):
    q, _ = build(spark, True)
    assert not any(s == "items/BBBB2222" and p in ("title", "language") for s, p, *_ in q)
    assert not any(p == "relations" for _, p, *_ in q)
    person = next(s for s, p, o, *_ in q if p == terms.LABEL and o == "Byron, Ada")
    roles = {s for s, p, o, *_ in q if p == "hasCreator" and o == person}
    assert sum((s, terms.LABEL, "author", None, None, G) in q for s in roles) == 1


def test_same_nodes_in_every_run(spark):
    assert build(spark, False)[0] == build(spark, False)[0]


def test_lists_and_thresholds(spark):
    q, _ = build(spark, True, white=["title", "place"])
    assert not any(p in ("volume", "tags") for _, p, *_ in q) and any(p == "title" for _, p, *_ in q)
    q, _ = build(spark, True, black=["place", "creators"])
    assert not any(p in ("place", "hasCreator") for _, p, *_ in q) and any(p == "volume" for _, p, *_ in q)
    q, _ = build(spark, True, rdf_mapping=["publisher"])
    assert ("items/AAAA1111", "place", "London; Paris", None, None, G) in q
    assert ("items/NNNN3333", "parentItem", "AAAA1111", None, None, G) in q  # fields that are not listed are plain
    q, _ = build(spark, True, fuzzy=101)
    assert len({o for _, p, o, *_ in q if p == "place"}) == 3  # no matching: an entity a mention


def test_empty_library(spark):
    none = json_docs.from_objects(spark, [{"data": {}}]).limit(0)
    got = pipeline.build(spark, [library()], Context(vocab=V), "2024", sources={"Demo": (none, None, terms.empty(spark))})
    assert got.count() == 0


@pytest.mark.parametrize(
    ("text", "o", "dt"),
    [("12 March 1687", "1687", "gYear"), ("1450", "1450", "gYear"), ("c. 1999?", "1999", "gYear"), ("3.4.812", "0812-04-03", "dateTime"), ("undated", "undated", None), ("é1776", "é1776", None), ("1200-1210", "1200-01-01", "dateTime")],
)
def test_dates(spark, text, o, dt):
    row = spark.createDataFrame([(text,)], "s string").withColumn("parsed", parse_residue("s")).select(date_literal(F.col("s"), F.col("parsed")).alias("x")).first().x
    assert (row.o, row.o_dt) == (o, terms.XSD + dt if dt else None)


def test_iris_and_uuids(spark):
    from urllib.parse import quote

    texts = ["http://a.org/ü b?x=%2F&y=1#z", "no scheme/ü*~ +", "https://a.org/%25/~*'()"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", safe_iri(F.col("t")).alias("i"), terms.uuid5(uuid.NAMESPACE_URL, F.col("t")).alias("u"), file_name(F.col("t")).alias("f")).collect()
    for r in rows:
        has = r.t.startswith("http")
        assert r.i == (quote(r.t, safe=":/#?&=%") if has else "http://internal.invalid/" + quote(r.t, safe=""))
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.t))
    assert spark.range(1).select(file_name(F.lit("https://ex.org/a/b-c/d e/"))).first()[0] == "ex.org_a_b-c_d_e"


def test_languages(spark):
    rows = spark.createDataFrame([("German ", "de"), ("latino", "la"), ("klingon", "und"), ("zh", "zh")], "n string, c string").select("c", language_code(F.col("n")).alias("x")).collect()
    assert all(r.c == r.x for r in rows)


def test_config(tmp_path):
    a, b = {"x": 1, "m": {"p": 1}}, {"x": 2, "y": 3, "m": {"q": 2}}
    assert set_defaults(a, b) == {"x": 1, "y": 3, "m": {"p": 1}}
    assert set_defaults(a, b, "override") == {"x": 2, "y": 3, "m": {"q": 2}}
    assert set_defaults(a, b, "merge", ["m"]) == {"x": 1, "y": 3, "m": {"p": 1, "q": 2}}
    f = tmp_path / "c.yaml"
    f.write_text("context: {vocab: 'http://v#', base: 'https://b/'}\ndefaults: {mode: default, load_mode: json}\nlibraries:\n- {name: A, library_type: groups, library_id: '7', save_to: '/x/$'}\n- {name: B, library_type: odd}\n")
    context, (one, two) = load_config(str(f))
    assert (context.base_url, one.base_url, one.save_to, one.problems()) == ("https://b/", "https://b/groups/7", "/x/7", [])
    assert len(two.problems()) == 2


def test_classification(spark):
    assert json_docs.classify(json_docs.from_objects(spark, ITEMS)) == "items"
    assert json_docs.classify(json_docs.from_objects(spark, COLLECTIONS)) == "collections"
    assert json_docs.classify(json_docs.from_objects(spark, ITEMS).limit(0)) == "items"
    with pytest.raises(ValueError):
        json_docs.classify(json_docs.from_objects(spark, ITEMS + COLLECTIONS))
