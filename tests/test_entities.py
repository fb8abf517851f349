import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions.ratio import indel_ratio, ratio
from quillgraph.operators import entities
from quillgraph.runtime import components


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_ratio_properties(a, b):
    r = indel_ratio(a, b)
    assert 0 <= r <= 100 and r == indel_ratio(b, a) and (r == 100) == (a == b)


def test_ratio_expression(spark):
    rng = random.Random(3)
    pairs = [("kitten", "sitting"), ("", "x"), ("", ""), ("日本語", "日本")] + [("".join(rng.choices("abcd ", k=rng.randint(0, 9))), "".join(rng.choices("abcd ", k=rng.randint(0, 9)))) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - indel_ratio(r.a, r.b)) < 1e-9 for r in rows)


def _labels(rng, n):
    bases = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 14))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            s.insert(rng.randint(0, len(s)), rng.choice("abcdefghX"))
        out.append("".join(s))
    return out


def test_blocks_lose_no_pair(spark):
    rng = random.Random(5)
    for threshold in (60, 75, 90, 97):
        labels = sorted({x.lower() for x in _labels(rng, 60)})
        df = spark.createDataFrame([("k", x) for x in labels], "k string, label string")
        got = {(r.a, r.b) for r in entities.similar(df, ["k"], threshold).collect()}
        assert got == {(a, b) for a in labels for b in labels if a < b and indel_ratio(a, b) >= threshold}


def _sequential(labels, threshold, known=()):
    """The definition: one mention after the other against all labels so far. ``known``: (label, node)."""
    made = []
    for label, node in sorted(known):
        e = next((e for e in made if e["node"] == node), None)
        if e is None:
            made.append(e := {"node": node, "founder": None, "labels": []})
        e["labels"].append(label)
    out = {label: (node, None) for label, node in known}
    for label in dict.fromkeys(x.lower() for x in labels):
        if label in out:
            continue
        best, found = 0, None
        for e in made:
            for other in e["labels"]:
                score = indel_ratio(other, label)
                if score > best:
                    best, found = score, e
        if found is None or best < threshold:
            made.append(found := {"node": None, "founder": label, "labels": []})
        found["labels"].append(label)
        out[label] = (found["node"], found["founder"])
    return out


@pytest.mark.parametrize("in_task", [entities.IN_TASK, 0])
def test_resolution_is_the_sequential_one(spark, in_task):
    """In one pass a group and round by round, with ties, without and with known entities of several labels."""
    rng = random.Random(7)
    for threshold, labels, known in (
        (70.0, _labels(rng, 50), []),
        (90.0, _labels(rng, 50), []),
        (80.0, [f"item {rng.randint(100, 160)}" for _ in range(40)], [("item 107", "n1"), ("item 133", "n2"), ("item 155", "n1"), ("far away", "n3")]),
    ):
        df = spark.createDataFrame([("g", "t", x, i) for i, x in enumerate(labels)], "kb string, etype string, label string, rank int")
        old = spark.createDataFrame([("g", "t", x, n) for x, n in known], "kb string, etype string, label string, node string")
        got = {r.label: (r.node, r.founder) for r in entities.resolve(df, old if known else None, threshold, in_task).collect()}
        assert got == _sequential(labels, threshold, [k for k in known if k[0] not in labels] + [k for k in known if k[0] in labels])


def test_known_entities_win(spark):
    mentions = spark.createDataFrame([("g", "t", "Byron, Ada", 1), ("g", "t", "Other", 2)], "kb string, etype string, label string, rank int")
    known = spark.createDataFrame([("g", "t", "Byrón, Ada", "http://n/1")], "kb string, etype string, label string, node string")
    got = {r.label: (r.node, r.founder) for r in entities.resolve(mentions, known, 90.0).collect()}
    assert got["byron, ada"] == ("http://n/1", None) or got["byron, ada"][0] == "http://n/1"
    assert got["other"] == (None, "other")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(500, 500 + i) for i in range(1, 20)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_blocks_lose_no_pair_of_long_labels(spark):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    base, other = some(1300), some(700)
    labels = [base, "".join(c + "Z" for c in base).lower(), other, other + some(100), other[:500], some(900), "ab", "ba", "abc"]
    df = spark.createDataFrame([("k", x) for x in labels], "k string, label string")
    for threshold in (60, 80, 81, 90):
        got = {frozenset((r.a, r.b)) for r in entities.blocks(df, ["k"], threshold).collect()}
        for i, a in enumerate(labels):
            for b in labels[:i]:
                if indel_ratio(a, b) >= threshold:
                    assert frozenset((a, b)) in got, (threshold, len(a), len(b))
