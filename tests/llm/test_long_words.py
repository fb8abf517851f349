"""Runs of letters of any length are summed over all segmentations; numerals are no letters."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quillgraph.llm import language_id


def forward(word, vocab, p):
    """(sum over all segmentations, expected number of each piece), exactly."""
    w, number = "▁" + word, {x: i for i, x in enumerate(vocab.pieces, 1)}
    n = len(w)

    def spans(a):
        for b in range(a + 1, min(a + vocab.longest, n) + 1):
            piece = number.get(w[a:b])
            if piece or b == a + 1:
                yield b, piece or 0

    ahead, behind = [Fraction(0)] * (n + 1), [Fraction(0)] * (n + 1)
    ahead[0] = behind[n] = Fraction(1)
    for a in range(n):
        for b, piece in spans(a):
            ahead[b] += ahead[a] * p[piece]
    counts = {}
    for a in range(n - 1, -1, -1):
        for b, piece in spans(a):
            behind[a] += p[piece] * behind[b]
            counts[piece] = counts.get(piece, 0) + float(ahead[a] * p[piece] * behind[b] / ahead[n])
    return ahead[n], counts


@pytest.fixture(scope="module")
def model():
    vocab = language_id.vocabulary(None)
    p = np.random.default_rng(3).random((vocab.size, 2)) ** 4
    return vocab, p / p.sum(axis=0)


WORDS = ["a", "water", "straße", "日本語の文章", "thewaterofthetide" * 4, "dieunendlichegeschichte" * 12, "海は広いな大きいな" * 15, "abcdefgh", "x" * 41]


def test_scores_and_counts_of_long_words(model):
    vocab, p = model
    got = language_id.word_scores(WORDS, vocab, p)
    for k in range(2):
        exact = [Fraction(float(x)) for x in p[:, k]]
        total = np.zeros(vocab.size)
        for i, w in enumerate(WORDS):
            likely, counts = forward(w, vocab, exact)
            assert got[i, k] == pytest.approx(math.log(likely.numerator) - math.log(likely.denominator), rel=1e-9)
            for piece, n in counts.items():
                total[piece] += (i + 1) * n
        assert language_id.expected_counts(WORDS, np.arange(1.0, len(WORDS) + 1), vocab, p[:, k]) == pytest.approx(total, abs=1e-6)


def test_a_cut_changes_the_score(model):
    vocab, p = model
    word = "thewaterofthetide" * 4
    whole, a, b = language_id.word_scores([word, word[:40], word[40:]], vocab, p)
    assert abs(whole - a - b).max() > 0.1 and language_id.text_words(word.upper()) == [word]


def test_numerals_are_no_letters(spark, model):
    assert language_id.text_words("²½Ⅷ 12_3") == [] and language_id.text_words("x²y Ⅷabc Über") == ["x", "y", "abc", "über"]
    vocab, p = model
    docs = spark.createDataFrame([(1, "²½Ⅷ"), (2, "²½Ⅷ water")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, ["en", "de"], p, np.log([0.5, 0.5])).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] in ("en", "de")
