"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is
written as Parquet and read again as the next one's documents, so a lost executor costs the stage
at hand and nothing before it. All but the last return the columns of ``documents``, whatever others
the table has beside ``doc_id`` and ``text``; a table without ``source`` has empty paths.

Defined cases: a null, empty or wordless text fails the quality rules; where it reaches a later stage
it is kept, is a copy of other such texts, overlaps with nothing and is packed as its end id. Rows
without an id are judged by their texts and never go as copies; rows that repeat an id go or stay
together as copies, and one by one as contaminated. Of copies the smallest id stays. An empty table
stays empty, and an empty ``labels`` or ``benchmark`` rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontamination, minhash, packing, quality, secrets
from quillgraph.llm.common import cut, fresh_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the likelihood ratio."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (SimHash and MinHash of five-word shingles, similarity 0.8)."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return packing.pack(cut(spark, packing.token_pieces(docs.select("doc_id", "text"))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("remove_secrets", remove_secrets),
    ("pack", pack),
]

#: Hashes, tokenizers and the forest have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
