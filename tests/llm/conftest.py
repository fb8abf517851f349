import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and to in that tide moon water river stone north wind harbour light letter paper ship sail storm".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("label", T.StringType()), T.StructField("hash", T.LongType())])


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) * (rng.random() < 0.4) for _ in range(n))


#: Texts of every awkward kind: null, empty, white space, no letters, repeated, very long, odd characters.
TEXTS = [
    None, "", "  \n\t ", "12 34 !!", "one", "Über ça и 日本語 ñandú", prose(1, 60), prose(1, 60), prose(2, 300), prose(3, 20_000),
    "same line here\n" * 12, "a b c d e f g h " * 20, 'x token = "' + "0123456789abcdef" * 2 + '01abcdef" y', "\x1c odd \x85 <|endoftext|> 'S it's", "!!! ### $$$ %%% " * 30, prose(4, 45), prose(4, 44) + " Changed",
]


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], f"src{i % 2}" if i % 5 else None, len(t or ""), "clash", i) for i, t in enumerate(TEXTS)]
    return [*out, (None, prose(9, 30), "en", "s", 1, "clash", 1), (6, TEXTS[6], "en", "s", 1, "clash", 2)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
