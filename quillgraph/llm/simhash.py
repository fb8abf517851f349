"""SimHash near-duplicate detection by multi-index hashing.

Texts become 64-bit fingerprints in one scan. Equal fingerprints are collapsed first. Links of at
most ``radius`` bits between different fingerprints are found by multi-index hashing: the bits are
cut into ``segments`` parts, one of which differs by at most ``radius // segments`` bits in any
linked pair. Every fingerprint enters one table a segment under its own segment value, and probes
it with the small Hamming ball around that value; complete distances are verified in the join.

Two values that differ in one bit meet once: only the one that has a 0 there probes with a 1. A
ball of radius r thus costs the flips of zero bits alone for r = 1.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated
rows give repeated results; a null ``doc_id`` keeps its row and its fingerprint and is left out of
the smallest id of its component (null if that has no other id); columns beyond ``doc_id`` and
``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: str | None, words: int = 4) -> int:
    """Fingerprint of one text; see op3 for its definition."""
    from xxhash import xxh64_intdigest as digest

    # bytes.split() splits at exactly \x20 and \x09-\x0D
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return digest(joined, 42)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: 1 - words].tolist(), end[words - 1 :].tolist())
    h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), "<u8", len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column("text")), "<u8", batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": fp.view("<i8")})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``count`` near-equal parts of 64 bits."""
    cuts = [round(64 * k / count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _ball(value, bits: int, radius: int):
    """Array of ``value`` and all values that have up to ``radius`` more bits set.

    A pair that differs in bits of both directions is not on either's list, so for radius 2 and
    more all flips are listed instead.
    """
    from itertools import combinations

    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    if radius <= 1:
        listed = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseAND(m) == 0)
        return F.transform(listed, lambda m: value.bitwiseOR(m))
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _part(column, first: int, bits: int):
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def near_links(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """Links (a, b) in proportion to the fingerprints that join most of any dense cluster.

    A row and the smallest fingerprint of the same segment value, if they are linked; and pairs one
    bit apart, by flipping each zero bit and an equi-join on the whole fingerprint.
    """
    values = F.array(*[F.struct(F.lit(k).alias("k"), _part(F.col("fp"), *s).alias("v")) for k, s in enumerate(_segments(segments))])
    at = fps.select("fp", F.explode(values).alias("s")).select("fp", "s.*")
    low = at.groupBy("k", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = at.join(low, ["k", "v"]).where(f"fp <> b and bit_count(fp ^ b) <= {radius}").select(F.col("fp").alias("a"), "b")
    flips = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    up = fps.select("fp", F.explode(F.filter(flips, lambda m: F.col("fp").bitwiseAND(m) == 0)).alias("m"))
    up = up.select(F.col("fp").alias("a"), F.col("fp").bitwiseOR(F.col("m")).alias("b"))
    return stars.union(up.join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))


def links(fps: DataFrame, radius: int = 4, segments: int = 3, group: str | None = None, name: str | None = None) -> DataFrame:
    """All pairs (a, b) of different rows of ``fps`` (fp) at most ``radius`` bits apart.

    With ``group``, pairs of that column's values instead, those of different rows that are connected.
    With ``name``, pairs of that column's values, of rows of different groups; fingerprints may be equal.
    """
    differ = ("na <> nb" if name else "a <> b") + (" and ga <> gb" if group else "")
    keep = f"bit_count(a ^ b) <= {radius} and {differ}"
    side = lambda x: [F.col("fp").alias(x)] + ([F.col(group).alias("g" + x)] if group else []) + ([F.col(name).alias("n" + x)] if name else [])
    left, right = side("a"), side("b")
    probe = table = None
    for k, (first, bits) in enumerate(_segments(segments)):
        value = _part(F.col("fp"), first, bits)
        p = fps.select(*left, F.lit(k).alias("k"), F.explode(_ball(value, bits, radius // segments)).alias("v"))
        t = fps.select(*right, F.lit(k).alias("k"), value.alias("v"))
        probe, table = (p, t) if probe is None else (probe.union(p), table.union(t))
    x, y = probe.alias("x"), table.alias("y")
    out = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & F.expr(keep))
    ends = ("na", "nb") if name else ("ga", "gb") if group else ("a", "b")
    return out.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, segments: int = 3, words: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row of ``docs``."""
    spark = docs.sparkSession
    rows = common.cut(spark, fingerprints(docs, words))
    fps = common.cut(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    first = common.cut(spark, near_links(fps.select("fp"), radius, segments).distinct())
    dense = common.components(spark, first)
    grouped = fps.select("fp").join(dense, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("g"))
    grouped = common.cut(spark, grouped)
    # the components found first are the nodes of the second run
    over = common.components(spark, links(grouped, radius, segments, "g"))
    named = grouped.join(over, F.col("g") == F.col("node"), "left").select("fp", F.coalesce("root", "g").alias("root"))
    named = common.cut(spark, named.join(fps, "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without all but the smallest ``doc_id`` of each component.

    Rows without an id cannot be named as copies of one another, and stay; rows that repeat an id
    are one document, and go or stay together.
    """
    found = near_duplicates(docs, **settings).where("doc_id <> component_id").select("doc_id").distinct()
    found = common.settle(docs.sparkSession, found)  # the planner broadcasts it only if it is small
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
