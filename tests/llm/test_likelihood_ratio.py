"""The quality rules' likelihood ratio against one counted in Python."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from quillgraph.llm import quality

from .conftest import prose


def buckets(text):
    """Buckets of the words and of the pairs of adjacent words, by the definition of Spark's xxhash64."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of = lambda raw, seed: xxhash.xxh64_intdigest(raw, seed)
    h = [of(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [of(struct.pack("<Q", b), of(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % quality.BUCKETS for x in h + pairs]


def test_ratio(spark, rows, docs, empty):
    labels = [(7, 1, 0), (8, 1, 0), (9, 1, 1), (6, 0, 0), (15, 1, 0), (15, 0, 0), (16, 1, None), (None, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {7, 8, 16}  # 9 is toxic, the labels of 15 disagree
    raw, good = Counter(dict.fromkeys(range(quality.BUCKETS), 1)), Counter()
    for i, text, *_ in rows:
        raw.update(buckets(text))
        if i in trusted:
            good.update(buckets(text))
    total, n = sum(raw.values()), sum(good.values())
    ratio = {b: math.log((good[b] + quality.PRIOR * raw[b] / total) / (n + quality.PRIOR) / (raw[b] / total)) for b in raw}
    got = sorted(((r.doc_id, r.n_words, r.llr, r.kept, r.base_failed) for r in quality.judge(docs, table).collect()), key=lambda r: (str(r[0]), r[1]))
    expected = sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), sum(ratio[b] for b in buckets(t)) / max(len(buckets(t)), 1)) for i, t, *_ in rows), key=lambda r: (str(r[0]), r[1]))
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    for a, b in zip(got, expected):
        assert a[2] == pytest.approx(b[2], abs=1e-9)
        assert a[3] == (not a[4] and a[2] >= quality.THRESHOLD)
    assert prose(1, 60) and quality.judge(empty, table).count() == 0
