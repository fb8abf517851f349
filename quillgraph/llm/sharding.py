"""Sharding by a hierarchical weighted hash tree.

A tree has regions, a region has racks, a rack has shards with weights. A document descends the
three levels; at each it goes to the child with the least ``-ln(u) / weight``, where u in (0, 1]
is a hash of the document's id and the child's name alone. A child's weight is the sum of its
shards. Changing one weight changes only the draws of that child and its ancestors, so documents
move only into or out of the subtrees whose weights change.

``grow`` adds a shard as a region of its own, so one more shard takes documents only into itself.

Defined cases: a null id is hashed as the empty name; equal ids share a shard (the ``key`` law);
repeated rows each get a slot; a null text has size 1 and the checksum of no bytes; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Regions of racks of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]

#: Hexadecimal digits of the hash by which a shard's rows are dealt out for numbering.
SLOT_DIGITS = 3


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards 0 to ``shards`` - 1 of weight 1, filled into racks and regions in order."""
    rack = [[(s, 1.0) for s in range(a, min(a + per_rack, shards))] for a in range(0, shards, per_rack)]
    return [rack[a : a + racks] for a in range(0, len(rack), racks)]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a new region."""
    new = 1 + max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(new, weight)]]]


def weight(node) -> float:
    return node[1] if isinstance(node, tuple) else sum(map(weight, node))


def draw(key: Column, name: Column, w: Column) -> Column:
    """Weighted draw of one child: 52 bits of the MD5 of the key and the child's name."""
    n = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((n + 1) / F.lit(float(2**52))) / w


def place(key: Column, tree: Tree) -> Column:
    """Shard of a key (a non-null string column)."""

    def first(node) -> int:
        return node[0] if isinstance(node, tuple) else first(node[0])

    def children(nodes: list, level: str) -> Column:
        # a node is named by its first shard, so that added nodes rename none
        return F.array(*[F.struct(F.lit(f"{level}{first(n)}").alias("name"), F.lit(float(weight(n))).alias("w"), F.lit(i).alias("i"), F.lit(first(n)).alias("shard")) for i, n in enumerate(nodes)])

    def least(nodes: Column) -> Column:
        draws = F.transform(nodes, lambda c: F.struct(draw(key, c["name"], c["w"]).alias("d"), c["i"].alias("i"), c["shard"].alias("shard")))
        return F.array_min(draws)

    regions = children(tree, "region")
    racks = F.array(*[children(region, "rack") for region in tree])
    shards = F.array(*[F.array(*[children(rack, "shard") for rack in region]) for region in tree])
    return common.let(least(regions)["i"], lambda r: common.let(least(F.get(racks, r))["i"], lambda k: least(F.get(F.get(shards, r), k))["shard"]))


def shard(docs: DataFrame, tree: Tree) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of each row.

    Slots count from 0 in each shard. Rows are numbered within parts of a shard and the parts'
    counts are added up, so no shard is sorted in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"))
    rows = rows.withColumns({"shard": place(F.col("key"), tree), "grown_shard": place(F.col("key"), grow(tree))})
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", "key", "text_crc32", "size"))).withColumn("part", F.substring("h", 1, SLOT_DIGITS))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("h", "doc_id")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    out = numbered.join(bases, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
