"""WARC bundles, token files, packing: exact round trips."""

import base64
import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import huffman, packing, tokens, warc
from quillgraph.llm.common import fresh_dir


def test_warc(spark, rows, docs, empty):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://u/"), "doc_id").alias("url"), F.col("text").alias("html"), "hash", F.lit("x").alias("digest"))
    index = warc.write(pages, fresh_dir(spark, "w"), frame=2000)
    got = sorted(map(tuple, warc.read(index).collect()), key=repr)
    holder = {}
    for i, text, *_ in rows:
        d = base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()
        holder[d] = max(holder.get(d, -1), -1 if i is None else i)
    expected = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own = i is None or i == holder[d]
        expected.append((i, len(raw), d, "response" if own else "revisit", None if own else holder[d]))
    assert got == sorted(expected, key=repr)
    assert index.agg(F.max("frame")).first()[0] > 0
    found = warc.lookup(index, spark.createDataFrame([(8,), (10,)], "page_id long")).collect()
    assert {r.page_id: bytes(warc.parse(r.record)[1]).decode() for r in found} == {i: t for i, t, *_ in rows if i in (8, 10)}
    none = warc.write(empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")), fresh_dir(spark, "w"))
    assert warc.read(none).count() == 0
    big = warc.write(pages, fresh_dir(spark, "w"), least=50)
    small = [r for r in warc.read(big).collect() if r.payload_bytes < 50]
    assert all(r.record_type == "response" for r in small)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=60), st.integers(0, 2**31))
def test_code_lengths_are_best(counts, seed):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts)
    used = counts > 0
    assert ((lengths > 0) == used).all()
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        heap = sorted(counts[used].tolist())
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert int((lengths.astype(int) * counts).sum()) == cost
    if used.any():
        ids = np.random.default_rng(seed).choice(np.flatnonzero(used), 700).astype("<u4")
        blocks, bits = huffman.pack(ids, huffman.canonical(lengths)[0], lengths)
        assert (huffman.unpack(len(ids), blocks, bits, huffman.decode_table(lengths)) == ids).all()


def test_code_length_limit():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = huffman.code_lengths(np.array(fibonacci))
    assert lengths.max() == 16 and sum(2.0 ** -int(x) for x in lengths) <= 1


def test_token_files(spark, rows, docs, empty):
    files = huffman.encode(docs, fresh_dir(spark, "t"), 50_257)
    got = huffman.digests(files).collect()
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert huffman.digests(huffman.encode(empty, fresh_dir(spark, "t"), 50_257)).count() == 0


def test_cached_encoding_is_exact():
    rng = random.Random(1)
    parts = ["a", "B", "Àb", "thando", "ÿ", "ĭ", "&", "(", "-", "*", "ħ", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'", "1", "23", "!", ".", ",", "ß", "Σ", "σς", "İ", "日本", "́", "<|endoftext|>", "_", "\r\n", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.encoder(name)
        fresh = Tokenizer.from_file(public_tokenizers.path(name))
        expected = [np.array(x.ids, "<u4").tobytes() for x in fresh.encode_batch(texts, add_special_tokens=False)]
        assert e.ids(texts) == expected and e.ids([None, ""]) == [b"", b""]
        cache, room, e.cache, e.room = e.cache, e.room, {}, 0  # a full cache learns nothing more
        assert e.ids(texts[:200]) == expected[:200] and not e.cache
        e.cache, e.room = cache, room


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_best_fit(sizes):
    sizes = np.array(sizes)
    bins = packing.best_fit_decreasing(sizes, 100)
    assert np.bincount(bins, weights=sizes).max() <= 100
    assert packing.lower_bound(sizes, 100) <= bins.max() + 1


def test_packing(spark, rows, docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    pieces = packing.token_pieces(docs, capacity=256).cache()
    packed = packing.pack(pieces, 256).collect()
    enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, text, *_ in rows:
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(expected, key=repr)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert all(a == sum(n for _, n in p[:k]) for k, (a, _) in enumerate(p)) and sum(n for _, n in p) <= 256
    total = sum(e[3] for e in expected)
    assert len(places) <= -(-total // 256) + 2
    assert packing.pack(packing.token_pieces(empty)).count() == 0
