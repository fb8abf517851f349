"""Near copies by the Jaccard similarity of their word shingles: SimHash and MinHash, then exact sets.

A text is the set of its runs of five words (or the run of all its words, if it has fewer), as
64-bit hashes. Texts of equal sets are collapsed first; then only the texts that share a value are
scanned again for their sets, so the others' sets are never written. Each text has ``BANDS`` values of
``ROWS`` minima each; two texts that share a value are compared by their complete sets, and are
linked if the similarity is ``PERCENT`` or more. A pair of similarity s shares a value with
probability 1 - (1 - s^4)^20: 0.99997 at 0.8, more above. No link is made without the exact check.

SimHash comes first, by op3's operator: fingerprints of the same shingles, and multi-index hashing of
all that are at most ``RADIUS`` bits apart. Most pairs near 0.8 are further apart than any radius
that multi-index hashing can search, so fingerprints alone would lose them; the bands find those.
Both only propose pairs.

Of the texts that share a value, each is first compared with the one that shares values with most
others. Pairs are then formed only between texts that these links leave in different components, and
only where two exact bounds allow a link: both have enough shingles that occur in other texts too,
and their sketches (parities of hashed members) do not differ in more bits than the sets may.

Defined cases: words are those of op3 (split at ASCII white space, A-Z in lower case); null texts
and texts without words are copies of one another; a null ``doc_id`` links texts like any other and
is left out of the smallest id of its component (null if that has no other id); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WORDS = 5
PERCENT = 80
BANDS = 20
ROWS = 4
#: Bits between fingerprints; three segments search up to five with balls of one bit.
RADIUS = 5
SEGMENTS = 3
#: Longs of a set's sketch.
SKETCH = 16
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(h: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of hashes of each row) of the shingle sets of rows with ``counts`` words each."""
    from .bytescan import mix

    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(h), bool)
    first[1:] = row[1:] != row[:-1]
    at = np.flatnonzero((left >= words) | first)
    size = np.minimum(left[at], words)
    total = size.astype(np.uint64)
    for k in range(words):
        on = size > k
        total[on] = total[on] * _STEP + h[at[on] + k]
    total, row = mix(total), row[at]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[new], np.bincount(row[new], minlength=len(counts))


def signatures(s: np.ndarray, counts: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(key of each row's set, its band values; rows without shingles have key 0 and unused values)."""
    from .bytescan import mix

    keys, values = np.zeros(len(counts), np.uint64), np.zeros((len(counts), bands), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return keys, values
    starts = (np.cumsum(counts) - counts)[some]
    keys[some] = mix(np.add.reduceat(mix(s + np.uint64(1)), starts) + counts[some].astype(np.uint64))
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _STEP)
    for band in range(bands):
        total = np.full(len(some), band + 1, np.uint64)
        for seed in seeds[band * ROWS : (band + 1) * ROWS]:
            total = total * _STEP + np.minimum.reduceat(mix(s ^ seed), starts)
        values[some, band] = mix(total)
    return keys, values


def sketches(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs a row: bit b is 1 if an odd number of the row's hashes fall on b.

    Two rows' sketches differ in no more bits than their sets differ in members.
    """
    from .bytescan import mix

    width = 64 * SKETCH
    row = np.repeat(np.arange(len(counts)), counts)
    bit = (mix(s + _STEP) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(row * width + bit, minlength=len(counts) * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, width), axis=1, bitorder="little").view(np.int64).reshape(len(counts), SKETCH)


def _text(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``t``, a hash of the text by which a second scan finds it again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("t", F.xxhash64("text"))


def scanned(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``t``, ``key``, ``n``, ``bands``, ``fp`` of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bytescan import words as split

        for batch in batches:
            for part in common.pieces(batch, "text"):
                s, counts = shingle_sets(*split(part.column("text")), words)
                keys, bands = signatures(s, counts)
                held = np.append(0, np.cumsum(np.where(counts > 0, BANDS, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(bands[counts > 0].ravel().view(np.int64)))
                fp = np.fromiter((simhash.fingerprint(x.as_py(), words) for x in part.column("text")), "<u8", part.num_rows)
                yield pa.record_batch([part.column("doc_id"), part.column("t"), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64)), lists, pa.array(fp.view(np.int64))], names=["doc_id", "t", "key", "n", "bands", "fp"])

    return _text(docs).select("doc_id", "t", "text").mapInArrow(common.freed(scan), "doc_id long, t long, key long, n long, bands array<long>, fp long")


def _sketch() -> list[str]:
    return [f"p{k}" for k in range(SKETCH)]


def _near(x: str, y: str, size_x: str, size_y: str, percent: int) -> str:
    """Sketches differ in no more bits than similar enough sets may differ in members; all others fail."""
    bits = " + ".join(f"bit_count({x}{p} ^ {y}{p})" for p in _sketch())
    return f"{100 + percent} * ({bits}) <= {100 - percent} * ({size_x} + {size_y})"


def shingled(docs: DataFrame, chosen: DataFrame, words: int = WORDS) -> DataFrame:
    """``key``, ``shingles``, ``p0`` and on (the sketch) of the different texts of ``docs`` whose ``t`` is among ``chosen``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bytescan import words as split

        for batch in batches:
            for part in common.pieces(batch, "text"):
                s, counts = shingle_sets(*split(part.column("text")), words)
                keys, _ = signatures(s, counts, bands=0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(s.view(np.int64)))
                sketch = np.ascontiguousarray(sketches(s, counts).T)
                yield pa.record_batch([pa.array(keys.view(np.int64)), lists, *sketch], names=["key", "shingles", *names])

    names = _sketch()
    texts = _text(docs).join(chosen, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    sets = texts.select("text").mapInArrow(common.freed(scan), "key long, shingles array<long>, " + ", ".join(f"{x} long" for x in names))
    return sets.groupBy("key").agg(*[F.first(x).alias(x) for x in ("shingles", *names)])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The distinct pairs (a, b) of ``pairs`` whose sets in ``sets`` are similar enough.

    Sketches are compared first, so the sets of most others are never sent.
    """
    sketch = lambda name: sets.select(F.col("key").alias(name), F.size("shingles").cast("long").alias("n" + name), *[F.col(p).alias(name + p) for p in _sketch()])
    close = pairs.select("a", "b").distinct().join(sketch("a"), "a").join(sketch("b"), "b").where(_near("a", "b", "na", "nb", percent)).select("a", "b")
    of = lambda name: sets.select(F.col("key").alias(name), F.col("shingles").alias("s" + name))
    both = close.join(of("a"), "a").join(of("b"), "b")
    # common / (all - common) >= p / 100
    same = F.size(F.array_intersect("sa", "sb")).cast("long") * (100 + percent) >= percent * (F.size("sa") + F.size("sb")).cast("long")
    return both.where(same).select("a", "b")


def _reach(common_most: str, x: str, y: str, percent: int) -> str:
    """Sets of ``x`` and ``y`` shingles are similar enough if they have ``common_most`` in common."""
    return f"{100 + percent} * {common_most} >= {percent} * ({x} + {y})"


def _possible(part: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``part`` (v, key, n, g) that may have a link to another ``g`` of their value, with ``c``.

    Values of one ``g`` alone need no more links. Of the others' sets, shingles that are in no other
    such set are in no intersection: ``c`` is the number of the rest, the most that any two can have
    in common. Copies that differ in words of their own are told apart so without forming pairs.
    """

    def mixed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("v").agg(F.min("n").alias("least"), (F.min("g") != F.max("g")).alias("mixed")).where("mixed").select("v", "least")

    part = common.cut(part.sparkSession, part.join(mixed(part), "v").drop("least"))
    inside = sets.join(part.select("key").distinct(), "key", "left_semi").select("key", F.explode("shingles").alias("s"))
    own = inside.groupBy("s").agg(F.min("key").alias("key"), F.count("*").alias("sets")).where("sets = 1").groupBy("key").agg(F.count("*").alias("own"))
    part = part.join(own, "key", "left").select("v", "key", "n", "g", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))
    part = part.where(f"100 * c >= {percent} * n")
    return part.join(mixed(part), "v").where(_reach("c", "n", "least", percent)).drop("least")


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys in proportion to ``texts`` (key, fp): those of equal fingerprints with one of them, and op3's first links."""
    of = texts.groupBy("fp").agg(F.min("key").alias("key"))
    equal = texts.join(of.select("fp", F.col("key").alias("b")), "fp").select(F.col("key").alias("a"), "b")
    linked = simhash.near_links(of.select("fp"), RADIUS, SEGMENTS).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    linked = linked.join(of.select(F.col("fp").alias("fa"), F.col("key").alias("a")), "fa").join(of.select(F.col("fp").alias("fb"), F.col("key").alias("b")), "fb")
    return equal.union(linked.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``component_id`` (smallest id of all texts linked with it) of every row of ``docs``."""
    spark = docs.sparkSession
    common.shared_dir(spark)
    rows = common.settle(spark, scanned(docs, words))
    texts = common.settle(spark, rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("t").alias("t"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    near = common.settle(spark, _by_fingerprint(texts.select("key", "fp")))
    at = texts.select("key", "n", F.explode("bands").alias("v"))
    many = at.groupBy("v").agg(F.count("*").alias("many")).where("many > 1")
    shared = common.cut(spark, at.join(many, "v"))
    # a value's centre is the text that meets most others over all its values, as the original of many copies does
    weight = shared.groupBy("key").agg(F.sum("many").alias("weight"))
    centre = shared.join(weight, "key").groupBy("v").agg(F.max(F.struct("weight", "key", "n")).alias("c"))
    shared = common.settle(spark, shared.join(centre, "v").select("v", "key", "n", F.col("c.key").alias("centre"), F.col("c.n").alias("centre_n")))
    chosen = common.settle(spark, texts.join(shared.select("key").union(_ends(near)).distinct(), "key", "left_semi").select("t").distinct())
    sets = common.settle(spark, shingled(docs, chosen, words))
    stars = shared.where("key <> centre").where(_reach("least(n, centre_n)", "n", "centre_n", percent)).select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"))
    first = common.cut(spark, verified(near.union(stars), sets, percent))
    joined = common.components(spark, first)
    # all fingerprints near one another that these links leave apart
    grouped = common.cut(spark, texts.select("key", "fp").join(joined, F.col("key") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "key").alias("g")))
    more = common.settle(spark, simhash.links(grouped, RADIUS, SEGMENTS, "g", "key"))
    lacking = common.settle(spark, texts.join(_ends(more), "key", "left_semi").join(sets, "key", "left_anti").select("t").distinct())
    if lacking.take(1):
        sets = sets.unionByName(common.settle(spark, shingled(docs, lacking, words)))
    part = shared.join(joined, F.col("key") == F.col("node"), "left").select("v", "key", "n", F.coalesce("root", "key").alias("g"))
    part = common.cut(spark, _possible(part, sets, percent).join(sets.select("key", *_sketch()), "key"))
    x, y = part.alias("x"), part.alias("y")
    fits = F.expr(f"x.v = y.v and x.key < y.key and x.g <> y.g and {_reach('least(x.c, y.c)', 'x.n', 'y.n', percent)} and {_near('x.', 'y.', 'x.n', 'y.n', percent)}")
    pairs = x.join(y, fits).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    rest = common.cut(spark, verified(pairs.union(more), sets, percent).join(joined.select(F.col("node").alias("a"), F.col("root").alias("ga")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("root").alias("gb")), "b", "left"))
    # the components found first are the nodes of the second run
    over = common.components(spark, rest.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
    roots = texts.select("key", "first").join(joined, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("g"))
    named = roots.join(over, F.col("g") == F.col("node"), "left").select("key", "first", F.coalesce("root", "g").alias("root"))
    named = common.cut(spark, named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key").join(named.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without all but the smallest ``doc_id`` of each component.

    Rows without an id stay; rows that repeat an id are one document, and go or stay together.
    """
    found = near_copies(docs, **settings).where("doc_id <> component_id").select("doc_id").distinct()
    found = common.settle(docs.sparkSession, found)  # the planner broadcasts it only if it is small
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
