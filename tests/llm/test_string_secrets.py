"""Recall of the built-in forest for secrets outside assignments."""

import random

import pytest

from quillgraph.llm import secrets

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.parametrize("chars", ["0123456789abcdef", ALNUM, ALNUM + "+/"])
@pytest.mark.parametrize("context", ["Authorization: Bearer {}", "curl -H 'Authorization: Bearer {}' https://x.org/a", "see https://api.org/v1/list?key={}&page=2 for it", "the api key is {} for now", "use the token {} to sign in"])
def test_recall_outside_assignments(context, chars):
    rng, model, found = random.Random(5), secrets.fit(), 0
    for _ in range(40):
        value = "".join(rng.choices(chars, k=40))
        text = context.format(value)
        at = text.index(value)
        found += any(s >= secrets.VERDICT and a <= at and b >= at + 40 for a, b, _, s in secrets.judged(text, "src1", model))
    assert found >= 38
