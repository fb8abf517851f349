"""Ids are those of the unaltered tokenizers, strings of special tokens among them."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import packing, tokens

BITS = ["x", " ", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "Don't", "été", "it's", "!!", "12", "a<b", "日本", "\t", "ſ", "İ", "\x1c", "<|endoftext"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids(name):
    rng, plain, mine = random.Random(2), Tokenizer.from_file(public_tokenizers.path(name)), tokens.encoder(name)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 9))) for _ in range(3000)]
    expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.ids(texts)] == expected
    ordinary = tokens.encoder(name, special=False).ids(["x <|endoftext|> y"])[0]
    assert len(ordinary) // 4 > len(plain.encode("x <|endoftext|> y", add_special_tokens=False).ids)


def test_small_cache():
    made = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), tokens._space_units, False)
    made.room = 3000
    texts = [f"word{i} other{i % 7} <|endoftext|>" for i in range(200)] * 2
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in made.ids(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(made.cache) < 20


def test_pack_until_nothing_is_gained(spark, monkeypatch):
    """Small groups exchange pieces until a round gains nothing."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rng = random.Random(6)
    sizes = [rng.randint(200, 900) for _ in range(400)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(bins) <= 1.04 * packing.lower_bound(np.array(sizes), 2048) + 1
