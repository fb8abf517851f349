"""Overlaps with the benchmark against all diagonals of all pairs."""

import random

import numpy as np

from quillgraph.llm import decontamination


def slow_overlaps(docs, items):
    """The longest accepted overlap of every diagonal, and the pairs that have one; on places, not hashes."""
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = np.array(text.split()), np.array(item.split())
            for diagonal in range(1 - len(b), len(a)):
                lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
                same = a[lo:hi] == b[lo - diagonal : hi - diagonal]
                total, best = np.append(0, np.cumsum(same)), None
                for x in range(len(same)):
                    for y in range(x + min(12, len(b)), len(same) + 1):
                        if 5 * (total[y] - total[x]) >= 4 * (y - x) and (not best or y - x >= best[1]):
                            best = (x, y - x, int(total[y] - total[x]))
                if best:
                    out.add((d, i, lo + best[0], lo + best[0] - diagonal, best[1], best[2]))
    return out


def test_overlaps_are_those_of_all_diagonals(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 20, 33, 60, 60])]
    items.append((90, items[12][1] + " " + items[13][1]))  # shares passages with others
    docs = []
    for k in range(60):
        _, item = items[k % len(items)]
        w = item.split()
        a = rng.randint(0, len(w) // 3)
        w = w[a : a + max(1, rng.randint(len(w) // 2, len(w)))]
        for at in rng.sample(range(len(w)), len(w) * (k % 4) // 10):
            w[at] = word()
        docs.append((k, " ".join([word() for _ in range(rng.randint(0, 25))] + w + [word() for _ in range(rng.randint(0, 25))] + (w if k % 9 == 0 else []))))
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = slow_overlaps(docs, items)
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == expected and len(expected) > 40


def test_long_changed_stretch_is_inside_one_overlap(spark):
    item = [f"w{i}" for i in range(900)]
    doc = ["before"] * 3 + item[:400] + [f"x{i}" for i in range(100)] + item[500:] + ["after"]
    got = decontamination.overlaps(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, 3, 0, 900, 800)]


def test_size_of_the_map():
    assert [decontamination.map_bits(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 1 << 30)] == [22, 22, 24, 25, 28]
