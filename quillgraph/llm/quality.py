"""Quality rules: repetition and length rules, then a hashed n-gram likelihood ratio.

The verdict is deterministic. Words and pairs of adjacent words of a document are hashed to
``BUCKETS`` buckets; two multinomials over the buckets are counted, one over all documents (the
raw corpus) and one over trusted documents. A document's score is the sum over its n-grams of
log(p_trusted / p_raw), divided by their number; documents below ``THRESHOLD`` are rejected, as
are those that fail the base rules.

Trusted documents are those labelled of good quality and not toxic. The trusted multinomial is
fitted on at most ``TRUSTED`` of them, those of least id hash: a documented bound on a labelled
sample, which bounds what is broadcast. The raw multinomial counts every document.

Everything is made of DataFrame expressions; no Python runs on the executors. Windows of eight
words are hashed by doubling: words, then pairs, then fours, then eights.

Defined cases: a null or empty text has no words and fails the base rules; a table without
labelled documents gives a ratio of zero, which passes; labels that disagree about a document
count as not trusted; repeated rows are judged alike; a null ``doc_id`` is judged like any other;
other columns of the documents are kept by ``keep`` and ignored by ``judge``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
TRUSTED = 20_000
#: N-grams in the raw proportions that the trusted multinomial starts from, against chance in few documents.
PRIOR = 300_000
#: Nats an n-gram, on average, by which the raw corpus may be likelier than the trusted text.
THRESHOLD = -0.06
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def doubled(h: Column, step: int) -> Column:
    """Hashes of windows twice as long: each joined with the one ``step`` places on."""
    n = F.size(h) - step
    return F.when(n > 0, F.transform(F.slice(h, 1, F.greatest(n, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(h, i + step)))).otherwise(F.array().cast("array<bigint>"))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS).cast("long")).cast("int")


def repeated_words(windows: Column, width: int = 8) -> Column:
    """Words that lie in a window whose hash occurs twice or more in ``windows``."""

    def counted(s: Column) -> Column:
        # s: (hash, place) in order; keep the places of hashes that have an equal neighbour
        at = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return common.let(F.array_sort(F.transform(at, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        # each window adds what the next one leaves uncovered
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(common.let(F.sort_array(pairs), counted))


def multinomials(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(p_trusted / p_raw) of each bucket.

    The raw counts have one added to each. The trusted multinomial starts from ``PRIOR`` n-grams
    in the raw proportions, so few trusted documents say little, and none say nothing. Only the
    bucket counts, of which there are ``BUCKETS``, come to the driver.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = good.where("q = 1 and coalesce(t, 0) = 0 and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    good = good.select("doc_id", F.lit(True).alias("trusted"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most TRUSTED ids of eight bytes
    text = text.join(F.broadcast(good), "doc_id", "left")
    grams = common.let(hashes(words(F.col("text"))), lambda h: F.transform(F.concat(h, doubled(h, 1)), bucket))
    counts = text.select("trusted", F.explode(grams).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    raw, target = [1.0] * BUCKETS, [0.0] * BUCKETS
    for b, r, g in counts.collect():
        raw[b] += r
        target[b] += g
    p_raw, n = [r / sum_r for sum_r in [sum(raw)] for r in raw], sum(target)
    return [math.log((t + PRIOR * p) / (n + PRIOR) / p) if n else 0.0 for t, p in zip(target, p_raw)]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's ``doc_id``, features, ``llr``, ``base_failed`` and ``kept``."""
    ratios = F.from_json(F.lit(json.dumps(multinomials(docs, labels))), "array<double>")
    return _judged(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass."""
    ratios = F.from_json(F.lit(json.dumps(multinomials(docs, labels))), "array<double>")
    return docs.where(_kept_of(F.coalesce(F.col("text").cast("string"), F.lit("")), ratios))


def _features(text: Column, ratios: Column) -> Column:
    def of(w: Column) -> Column:
        return common.let(hashes(w), lambda h1: common.let(doubled(h1, 1), lambda h2: of_hashes(w, h1, h2)))

    def of_hashes(w: Column, h1: Column, h2: Column) -> Column:
        def total(h: Column) -> Column:
            return F.aggregate(h, F.lit(0.0), lambda a, x: a + F.get(ratios, bucket(x)))

        windows = common.let(doubled(h2, 2), lambda h4: doubled(h4, 4))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            common.let(windows, repeated_words).alias("n_repeat_words"),
            (total(h1) + total(h2)).alias("sum"),
        )

    return common.let(words(text), of)


def _judged(docs: DataFrame, ratios: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _features(text, ratios).alias("f"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "f.*", "n_symbols", "n_dup_lines", _ratio(F.col("f")).alias("llr"), _failed(F.col("f")).alias("base_failed"), (~_failed(F.col("f")) & (_ratio(F.col("f")) >= THRESHOLD)).alias("kept"))


def _kept_of(text: Column, ratios: Column) -> Column:
    return common.let(_features(text, ratios), lambda f: ~_failed(f) & (_ratio(f) >= THRESHOLD))


def _failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def _ratio(f: Column) -> Column:
    """Sum over words and pairs, by their number; 0 for no words."""
    return F.coalesce(F.try_divide(f["sum"], F.greatest(2 * f["n_words"] - 1, F.lit(0))), F.lit(0.0))
