"""Short benchmark texts with a substituted word."""

import itertools

import pytest

from quillgraph.llm import decontamination


def allowed(n):
    """Which of ``n`` places are equal, in every way that IDENTITY allows."""
    for k in range(n - -(-4 * n // 5) + 1):
        for wrong in itertools.combinations(range(n), k):
            yield [i not in wrong for i in range(n)]


@pytest.mark.parametrize("n", range(1, 16))
def test_masks_hit_every_allowed_pattern(n):
    masks = [m for _, m in decontamination._masks([n])]
    for same in allowed(n):
        assert any(all(same[at + k] for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1)), same


def test_short_items_with_one_substituted_word(spark):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(3, 10)}
    docs, expected = [], set()
    for n, words in items.items():
        for at in range(n):
            doc = len(docs)
            docs.append((doc, " ".join(["before", *words[:at], "other", *words[at + 1 :], "after"])))
            if n >= 5:
                expected.add((doc, n))
    data = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(data, bench).collect()} == expected
