"""Secrets of any length are reported and removed as a whole."""

import hashlib
import random

import pytest

from quillgraph.llm import secrets

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def some(n, seed=1, chars=ALNUM):
    return "".join(random.Random(seed).choices(chars, k=n))


@pytest.mark.parametrize("n", [40, 512, 513, 800, 5000])
def test_values_run_to_their_delimiter(spark, n):
    value = some(n)
    text = f'see session_token="{value}" and password={value[::-1]}, then more'
    docs = spark.createDataFrame([(1, text, "src")], "doc_id long, text string, source string")
    got = sorted((r.start, r.length, r.value_sha256, r.secret) for r in secrets.scan(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(text.index(value), n, sha(value), True), (text.index(value[::-1]), n, sha(value[::-1]), True)]
    assert secrets.redact(docs).first().text == 'see session_token="[SECRET]" and password=[SECRET], then more'


def test_overlapping_candidates_become_their_union():
    token, tail = some(30), some(40, 2)
    # the string runs on where the assigned value ends at a known format's end, and the other way round
    text = f"api_key=AKIA{some(16, 3, ALNUM[:26])}/{tail}"
    assert secrets.candidates(text) == [(8, len(text), "aws_key")]
    text = f"token={token}:ghp_{tail}"
    assert secrets.candidates(text) == [(6, len(text), "github_token")]
    # a second name inside a value, and one that only begins at its end
    assert secrets.candidates("token=abc.password=defghi x") == [(6, 25, "assigned")]
    assert [c[:2] for c in secrets.candidates("token=abcdef.password= defghi x")] == [(6, 22), (23, 29)]


def test_coverage_of_the_whole_value():
    features = secrets.Features()
    value = some(600, 4, "0123456789") + "water" * 120
    assert features.coverage(value) == pytest.approx(0.5)
