"""Every stage on awkward rows and an empty table, and planted cases through the whole pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import prose
from .test_minhash import jaccard, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(77, 40)
    docs = [(i, prose(200 + i, 80)) for i in range(12)]
    near = docs[3][1].split()
    near[40] = "changed"
    extra = [
        (100, docs[0][1]), (101, " ".join(near)),  # an exact and a near copy
        (102, prose(300, 50) + " " + item + " " + prose(301, 30)), (103, prose(302, 40) + " " + " ".join(item.split()[:25])),  # benchmark passages
        (104, prose(303, 60) + ' api_token = "' + "".join(random.Random(1).choices("0123456789abcdef", k=700)) + '" ' + prose(304, 20)),  # a long secret
        (105, "few words"), (106, "a b c d e f g h " * 30), (107, None), (108, ""), (None, prose(305, 60)), (None, prose(305, 60)),
    ]
    rows = [(i, t, "en", None if i == 5 else f"src{i or 0}", 1, "mine", "k", True, 7) for i, t in docs + extra]
    names = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, _kept boolean, region int"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_planted_cases(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        docs = got.cache()
        rows = docs.collect()
        kept[name] = sorted((r.doc_id for r in rows), key=repr)
        assert all((r._row, r.key, r._kept, r.region) == ("mine", "k", True, 7) for r in rows)
    clean = list(range(12))
    assert kept["quality_rules"] == sorted([*clean, 100, 101, 102, 103, 104, None, None], key=repr)
    assert kept["near_dedup"] == sorted([*clean, 102, 103, 104, None, None], key=repr)
    assert kept["decontaminate"] == kept["remove_secrets"] == sorted([*clean, 104, None, None], key=repr)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert text[104] == prose(303, 60) + ' api_token = "[SECRET]" ' + prose(304, 20) and all(text[i] == prose(200 + i, 80) for i in clean)
    assert all(jaccard(shingles(text[a]), shingles(text[b])) < 0.8 for a in clean for b in clean if a < b)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert sorted((r.doc_id for r in packed.collect()), key=repr) == kept["remove_secrets"]
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, folder).collect()), key=repr) == kept["remove_secrets"]


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_rows_that_repeat_and_have_no_words(spark, folder):
    odd = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (105, 107, 108) OR doc_id IS NULL")
    odd = odd.union(odd).withColumn("doc_id", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, odd, folder).count() == odd.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() == odd.count()
    assert corpus_pipeline.quality_rules(spark, odd, folder).count() == 4  # those with words, and each of them
