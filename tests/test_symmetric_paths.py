"""Closures of symmetric paths, by components."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph import terms
from quillgraph.plans import paths


def _reached(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for a in out:
        todo = list(out[a])
        while todo:
            new = out[todo.pop()] - out[a]
            out[a] |= new
            todo += new
    return {(a, b) for a in out for b in out[a]}


@pytest.mark.parametrize("large", [2, 1000])
def test_symmetric_closure(spark, monkeypatch, large):
    monkeypatch.setattr(paths, "LARGE", large, raising=False)
    monkeypatch.setattr(paths, "closure", None)  # no round by round fixpoint
    rng = random.Random(large)
    edges = {(f"http://n/{rng.randint(0, 30)}", f"http://n/{rng.randint(0, 30)}") for _ in range(18)} | {("http://n/x", "http://n/x")}
    quads = terms.from_rows(spark, [(a, "iri", "http://p", b, "iri", None, None, "http://g") for a, b in sorted(edges)])
    p = paths.Link("http://p")
    got = paths.pairs(quads, paths.Repeat(paths.Alternative((p, paths.Inverse(p))), 1, True)).select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(_reached(edges | {(b, a) for a, b in edges}))
    assert not paths._symmetric(p) and not paths._symmetric(paths.Alternative((p, paths.Inverse(paths.Link("http://q")))))


def test_large_component_is_spread(spark):
    """No row of the pairs' plan leads to more than a block of them, and no task reads a whole component."""
    p = paths.Link("http://p")
    rows = [(f"http://n/{i}", "iri", "http://p", f"http://n/{i % 3}", "iri", None, None, "http://g") for i in range(3, 2500)] + [("http://n/a", "iri", "http://p", "http://n/a", "iri", None, None, "http://g")]
    rows += [("http://n/0", "iri", "http://p", "http://n/1", "iri", None, None, "http://g"), ("http://n/1", "iri", "http://p", "http://n/2", "iri", None, None, "http://g")]
    path = paths.Repeat(paths.Alternative((p, paths.Inverse(p))), 1, True)
    got = paths.pairs(terms.from_rows(spark, rows), path)
    counts = [x for x in got.select(F.spark_partition_id().alias("t")).groupBy("t").count().orderBy("t").collect()]
    assert sum(x["count"] for x in counts) == 2500 * 2500 + 1 and max(x["count"] for x in counts) < 2500 * 2500 / 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Generate explode")[1] and plan.count("Generate explode") == 2 and "Coalesce" in plan
    ends = got.groupBy("a").agg(F.count_distinct("b").alias("n")).groupBy("n").count().collect()
    assert sorted((x["n"], x["count"]) for x in ends) == [(1, 1), (2500, 2500)]
