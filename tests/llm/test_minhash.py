"""Near copies of the pipeline's stage against the Jaccard similarity of all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bytescan, minhash, simhash

from .conftest import prose
from .test_texts import lower, slow_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copy_texts():
    """Bases with copies of 1 to 6 changed words, chains of copies of copies, and one large group."""
    rng = random.Random(8)
    texts = []
    for base in range(12):
        now = prose(100 + base, rng.choice((60, 150, 400))).split()
        texts.append(" ".join(now))
        for step in range(5):
            w = list(now)
            for i in rng.sample(range(len(w)), max(1, len(w) * (1 + step % 3) // 100)):
                w[i] = f"changed{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
            now = w if base % 2 else now
    big = prose(999, 200).split()
    for _ in range(40):
        w = list(big)
        for i in rng.sample(range(len(w)), 2):
            w[i] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    return texts


def test_near_dedup_stage_keeps_what_brute_force_keeps(spark, rows):
    texts = [t for _, t, *_ in rows] + near_copy_texts()
    sets = [shingles(t) for t in texts]
    between = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= x < 0.95 for x in between) > 100 and sum(0.5 < x < 0.8 for x in between) > 20
    roots = slow_components(range(len(texts)), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    least = defaultdict(lambda: len(texts))
    ids = [i if i % 17 else None for i in range(len(texts))]
    for i, doc in enumerate(ids):
        if doc is not None:
            least[roots[i]] = min(least[roots[i]], doc)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    expected = [i for i, doc in enumerate(ids) if doc is not None and least[roots[i]] == doc]
    assert got == expected + [None] * ids.count(None)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_fingerprints_link_without_bands(spark, monkeypatch):
    whole = minhash.scanned
    monkeypatch.setattr(minhash, "scanned", lambda docs, words: whole(docs, words).withColumn("bands", F.array().cast("array<long>")))
    texts = near_copy_texts()
    sets = [shingles(t) for t in texts]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 5 and jaccard(sets[a], sets[b]) >= 0.8
    roots = slow_components(range(len(texts)), near)
    assert 15 < sum(i != r for i, r in roots.items()) < len(texts) - 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [roots[i] for i in range(len(texts))] == [r.component_id for r in sorted(minhash.near_copies(docs).collect())]


def test_shingle_sets():
    texts = [None, "a b", "A  b\n", "a b c d e f a b c d e", "", "b a"]
    s, counts = minhash.shingle_sets(*bytescan.words(pa.array(texts)))
    ends = np.cumsum(counts)
    got = [frozenset(s[e - c : e].tolist()) for e, c in zip(ends, counts)]
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert [[a == b for b in got] for a in got] == [[shingles(a) == shingles(b) for b in texts] for a in texts]
