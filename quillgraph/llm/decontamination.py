"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over adjacent words; its hash covers the words at the mask's ones and
ignores those at its zeros, so it survives substituted words there. The hashes of all benchmark
texts under all masks are joined with those of the corpus. Around each hit the corpus and benchmark
words are aligned, and an overlap is accepted if at least ``LEAST_WORDS`` aligned words (or the whole
of a shorter benchmark text) agree in at least ``IDENTITY`` of their places.

Words are compared in lower case and without ASCII punctuation. The corpus has one hash a word and
mask, far too many to shuffle. A bit map over the benchmark's hashes, of a size that follows their
number up to a bound, lets through the hits and a few others in the scan; what passes meets the
benchmark's table in an ordinary join. Hits of one passage form one region, a row however many
seeds it hits, with as many words on both sides as the longest benchmark text has: all that can be
aligned with it. Of a region, each benchmark text is sent the words that its diagonals meet.

Defined cases: null and empty texts overlap with nothing; a benchmark text of fewer than ``SHORT``
words is compared as a whole, through masks made for its length; repeated rows give
repeated results; a null ``doc_id`` is reported as null; a null ``item_id`` matches like any other;
other columns are ignored; an empty table on either side gives no overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed masks: five words taken of at most eight.
MASKS = ("11111", "1101011", "11001011", "10110011")
LEAST_WORDS = 12
#: Benchmark texts of fewer words have masks of their own.
SHORT = 8
IDENTITY = 0.8
#: Bits of the map a seed, and its least and most bits as powers of two: at most 32 MB are broadcast.
SEED_BITS, LEAST_BITS, MOST_BITS = 256, 22, 28


def seed_hashes(h: np.ndarray, counts: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a mask over the words ``h`` of rows with ``counts`` words each."""
    from .bytescan import mix

    span = len(mask)
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    at = np.flatnonzero(left >= span)
    total = np.full(len(at), np.uint64(number + 1), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    return at, mix(total)


def _whole(n: int) -> list[tuple[int, str]]:
    """(number, mask) of the masks of benchmark texts of just ``n`` words, if they have masks of their own.

    Below five words IDENTITY allows no substituted word. Of five to seven it allows one, at a place
    that one of three masks leaves out; from eight words on, MASKS hit whatever IDENTITY allows.
    """
    if n < len(min(MASKS, key=len)):
        return [(10 + n, "1" * n)]
    if n >= SHORT:
        return []
    cuts = [round(n * k / 3) for k in range(4)]
    return [(20 + 3 * n + k, "".join("01"[not cuts[k] <= i < cuts[k + 1]] for i in range(n))) for k in range(3)]


def _masks(lengths) -> list[tuple[int, str]]:
    """(number, mask) of all masks of benchmark texts of ``lengths`` words."""
    return [m for n in lengths for m in _whole(n) or enumerate(MASKS)]


def benchmark_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds: ``item``, ``at``, ``hash``; items: ``item``, ``item_id``, ``item_words``)."""
    spark = benchmark.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bytescan import words

        for batch in batches:
            for part in common.pieces(batch, "text"):
                h, counts = words(part.column("text"), plain=True)
                yield pa.record_batch({"item": part.column("item"), "item_id": part.column("item_id"), "item_words": _lists(h, counts)})

    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id())
    items = common.cut(spark, named.mapInArrow(common.freed(scan), "item long, item_id long, item_words array<long>").where("size(item_words) > 0"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, item in enumerate(batch.column("item").to_pylist()):
                h = _words(batch.column("item_words"), k).view(np.uint64)
                for number, mask in _masks([len(h)]):
                    at, s = seed_hashes(h, np.array([len(h)]), mask, number)
                    yield pa.record_batch({"item": pa.array(np.full(len(at), item)), "at": at, "hash": s.view(np.int64)})

    return common.cut(spark, items.select("item", "item_words").mapInArrow(hashed, "item long, at long, hash long")), items


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list array of ``values`` in rows of ``counts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _words(lists: pa.Array, row: int) -> np.ndarray:
    """The values of one row of a list array, without a copy."""
    return lists[row].values.to_numpy(zero_copy_only=False)


def map_bits(seeds: int) -> int:
    """Size of the map, as a power of two, for a number of seeds, within the bounds."""
    return min(max((SEED_BITS * max(seeds, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _probes(bits: int) -> tuple[int, int]:
    """Where the two keys of a hash in the map begin."""
    return 64 - bits, 64 - 2 * bits


def _in_map(seen: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the map has under both keys."""
    at = np.arange(len(h))
    for shift in _probes(bits):
        key = (h[at] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        at = at[(seen[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def _bit_map(seeds: DataFrame, bits: int) -> bytes:
    """Bits of all seeds' hashes. Made by tasks; one map of bounded size a task comes to the driver."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for shift in _probes(bits):
                out[(h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)] = True
        yield pa.record_batch({"bits": [np.packbits(out, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for (part,) in seeds.select("hash").repartition(min(4, max(1, seeds.sparkSession.sparkContext.defaultParallelism))).mapInArrow(common.freed(mapped), "bits binary").toLocalIterator():
        out |= np.frombuffer(part, np.uint8)
    return out.tobytes()


_REGION = "doc_id long, start long, doc_words array<long>, places array<long>, hashes array<long>"


def _regions(h: np.ndarray, counts: np.ndarray, at: np.ndarray, s: np.ndarray, before: int, behind: int):
    """(rows, starts in the rows, words, places, hashes) of the stretches around hits ``at``.

    A stretch begins ``before`` words ahead of its first hit and ends ``behind`` words after the
    beginning of its last one, or where the row does; hits whose stretches would meet share one.
    """
    order = np.argsort(at, kind="stable")
    at, s = at[order], s[order]
    ends = np.cumsum(counts)
    row = np.searchsorted(ends, at, "right")
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(at) > before + behind)) + 1
    first, last = np.append(0, cut), np.append(cut, len(at))
    r = row[first]
    base = (ends - counts)[r]
    low, high = np.maximum(at[first] - before, base), np.minimum(at[last - 1] + behind, ends[r])
    size = high - low
    words = h[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
    return r, low - base, _lists(words, size), _lists(at - np.repeat(low, last - first), last - first), _lists(s, last - first)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``doc_start``, ``item_start``, ``n_words``, ``n_equal`` of accepted overlaps.

    Starts are word numbers; one row for each pair and diagonal, the longest accepted overlap on it (of
    equally long ones the last).
    """
    spark = docs.sparkSession
    seeds, items = benchmark_seeds(benchmark)
    bits = map_bits(seeds.count())
    seen = spark.sparkContext.broadcast(_bit_map(seeds, bits))  # 2^MOST_BITS bits at most
    sizes = items.select(F.size("item_words").alias("n"))
    short = sorted(r[0] for r in sizes.where(F.col("n") < SHORT).distinct().collect())
    longest = sizes.agg(F.max("n")).first()[0] or 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bytescan import words

        known = np.frombuffer(seen.value, np.uint8)

        def hits(h, counts, masks):
            found = []
            for number, mask in masks:
                at, s = seed_hashes(h, counts, mask, number)
                hit = _in_map(known, bits, s)
                found.append((at[hit], s[hit]))
            return (np.concatenate(x) for x in zip(*found))

        for batch in batches:
            for part in common.pieces(batch, "text"):
                h, counts = words(part.column("text"), plain=True)
                # a diagonal through a hit lies within the longest item's words on both sides, a whole short item's at the hit
                for masks, before, behind in [(enumerate(MASKS), longest, longest), *[(_whole(n), 0, n) for n in short]]:
                    at, hashes = hits(h, counts, masks)
                    if len(at):
                        r, *columns = _regions(h, counts, at, hashes, before, behind)
                        yield pa.record_batch([part.column("doc_id").take(pa.array(r)), *columns], names=["doc_id", "start", "doc_words", "places", "hashes"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    regions = common.cut(spark, text.mapInArrow(common.freed(scan), _REGION).withColumn("region", F.monotonically_increasing_id()))
    hits_of = regions.select("region", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("region", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    lines = hits_of.join(seeds, "hash").groupBy("region", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    pairs = lines.join(items, "item").join(regions.select("region", "doc_id", "start", "doc_words"), "region")
    # of a region, the words that these diagonals meet
    low = F.greatest(F.array_min("diagonals"), F.lit(0))
    pairs = pairs.withColumn("low", low).withColumn("doc_words", F.slice("doc_words", low.cast("int") + 1, (F.array_max("diagonals") + F.size("item_words") - low).cast("int")))
    return pairs.select("doc_id", "item_id", "start", "low", "diagonals", "doc_words", "item_words").mapInArrow(common.freed(_verify), "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
    for batch in batches:
        out = []
        ids, others, starts, lows = (batch.column(k).to_pylist() for k in range(4))
        for k in range(batch.num_rows):
            doc, item = _words(batch.column("doc_words"), k), _words(batch.column("item_words"), k)
            for diagonal in np.sort(_words(batch.column("diagonals"), k)).tolist():
                found = aligned(doc, item, diagonal - lows[k])
                if found:
                    a, n, equal = found
                    out.append((ids[k], others[k], starts[k] + lows[k] + a, a + lows[k] - diagonal, n, equal))
        cols = zip(*out) if out else [[]] * 6
        yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], names=names)


def aligned(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in ``doc``, words, equal words) of the longest accepted overlap where doc[i] meets item[i - diagonal]."""
    a, b = max(0, diagonal), min(len(doc), len(item) + diagonal)
    if b <= a:
        return None
    same = (doc[a:b] == item[a - diagonal : b - diagonal]).astype(np.int64)
    least = min(LEAST_WORDS, len(item))
    # score of i..j: equal words minus IDENTITY of all; accepted overlaps have prefix[j] >= prefix[i]
    prefix = np.concatenate([[0], np.cumsum(5 * same - round(5 * IDENTITY))])
    best = None
    low = np.minimum.accumulate(prefix)
    for j in range(len(prefix) - 1, 0, -1):
        if best and j <= best[1]:
            break
        i = int(np.searchsorted(-low, -prefix[j], "left"))  # the first place that is no higher
        if j - i >= least and (not best or j - i > best[1]):
            best = (i, j - i)
    if not best:
        return None
    i, n = best
    return a + i, n, int(same[i : i + n].sum())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that overlap with the benchmark.

    Each row is judged by its own text, also where rows have no ``doc_id`` or repeat one.
    """
    spark = docs.sparkSession
    row = common.free(docs, "_row")
    rows = common.settle(spark, docs.withColumn(row, F.monotonically_increasing_id()))  # written, so the numbers stay
    found = overlaps(rows.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(common.settle(spark, found), row, "left_anti").select(*docs.columns)
