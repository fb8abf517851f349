"""The queries op1 to op10: thin forms of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import cut, fresh_dir, table


def op1_warc_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(write(table(spark, sf_dir, "pages", "page_id", "url", "html"), fresh_dir(spark, "warc")))


def op2_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import digests, encode

    return digests(encode(table(spark, sf_dir, "documents", "doc_id", "text"), fresh_dir(spark, "tokens"), vocabulary=50_257))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, predict

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, *fit(docs.where(~held_out(docs["doc_id"]))))


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import even_tree, shard

    return shard(table(spark, sf_dir, "documents", "doc_id", "text"), even_tree(16))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(cut(spark, token_pieces(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op8_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import fit, held_out, score

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(docs.where(~held_out(docs["doc_id"])), fresh_dir(spark, "model")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that share a passage: the longest such overlap."""
    from pyspark.sql import functions as F

    from .decontamination import overlaps

    found = overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    longest = F.max(F.struct("n_words", "n_equal", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", (-F.col("m.d")).alias("doc_start"), (-F.col("m.i")).alias("item_start"), "m.n_words", "m.n_equal")


QUERIES = {f.__name__: f for f in (op1_warc_seekable_bundles, op2_huffman_token_files, op3_simhash_near_dedup, op4_language_id, op5_hash_tree_sharding, op6_quality_rules, op7_best_fit_packing, op8_kneser_ney_scoring, op9_secret_scan, op10_spaced_seed_decontamination)}
ORACLE_SQL: dict[str, str] = {}

_HEX = "sha1(coalesce(html, ''))"
_FIVE = "('0x' || substr({h}, {at}, 5))::INTEGER"
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_FIVE.format(h='hex', at=1 + 5 * k)} >> {shift}) & 31), 1)" for k in range(8) for shift in (15, 10, 5, 0)
)
ORACLE_SQL["op1_warc_seekable_bundles"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, {_HEX} AS hex FROM pages),
     g AS (SELECT hex, max(page_id) AS holder FROM p GROUP BY hex)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder THEN holder END AS refers_to
FROM p JOIN g USING (hex)
"""
