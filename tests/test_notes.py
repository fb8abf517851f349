"""Layout of notes and their links: a pass that parses each note once, whatever keys repeat."""

import duckdb
import pytest

from quillgraph import bridge_documents, runtime
from quillgraph.operators import notes


@pytest.fixture
def parts(spark, tmp_path):
    """Parts of which two share a key."""
    rows = [(k, f"n{k}", f"Brand#{k % 3}", "LARGE" if k % 2 else "SMALL", k % 20, 1.0) for k in (*range(30), 7)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def _by_sql(name, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet/*.parquet'")
    return sorted(map(repr, con.execute(bridge_documents.bridge.ORACLE_SQL[name]).fetchall()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_layout_of_notes_that_share_a_key(spark, parts):
    got = bridge_documents.note_layout(spark, parts)
    assert sorted(map(repr, map(tuple, got.collect()))) == _by_sql("note_layout", parts)
    assert "Join" not in _plan(got) and _plan(got).count("MapInArrow") == 1


def test_layout_is_that_of_the_annotations(spark):
    html = "<p>a <em>b</em> <code>1</code> <em>c</em></p><h1>H</h1><p><em>d</em></p><h2>I</h2><blockquote>q</blockquote><code>2</code>"
    df = spark.createDataFrame([("http://n/1", html), ("http://n/2", html), ("http://n/3", None), ("http://n/4", "")], "note string, html string")
    found = notes.annotations(df).collect()
    text = {r.id: r.text for r in found}
    want = [(r.note, r.kind, r.text, text.get(r.structure), text.get(r.locator)) for r in found]
    assert sorted(map(repr, want)) == sorted(map(repr, map(tuple, notes.layout(df).collect())))
    assert ("http://n/1", "Annotation", "b", None, "1") in want and ("http://n/1", "Quotation", "q", "I", "2") in want


def test_links_keep_no_quads(spark, parts, monkeypatch):
    kept = []
    for where, name in ((bridge_documents, "cut"), (bridge_documents, "written")):
        monkeypatch.setattr(where, name, lambda spark, df: kept.append(df.columns) or runtime.written(spark, df), raising=False)
    got = bridge_documents.knowledge_base_links(spark, parts)
    assert [c for c in kept if "kind" in c or "o" in c] == [["note", "id", "kind", "types", "text", "level", "doc", "structure", "locator"]]
    assert sorted(map(repr, map(tuple, got.collect()))) == _by_sql("knowledge_base_links", parts)
