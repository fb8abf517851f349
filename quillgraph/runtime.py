"""What every part of the engine shares: the shared folder, checkpoints, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and Spark is local (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder (not created)."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, in reliable storage."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. Unlike a checkpoint it brings no constraints along, which grow from round to round in loops."""
    path = fresh_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row: filters and later columns read a generator's row and not the expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in enough files for all cores, if it is read in fewer tasks."""
    spark = df.sparkSession
    most = 4 * spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= most else written(spark, df.repartition(most, key))


def appended(spark: SparkSession, parts: list[tuple[int, DataFrame]], new: DataFrame, *keys: str) -> list[tuple[int, DataFrame]]:
    """``parts`` (appended tables, their rows) and ``new``: equal numbers are merged, so a row is rewritten once a doubling."""
    parts = [*parts, (1, new)]
    while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
        (n, x), (_, y) = parts.pop(), parts.pop()
        parts.append((2 * n, written(spark, x.union(y).repartition(*keys))))
    return parts


def _print(df: DataFrame):
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).collect()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Least reachable node of every node of ``edges`` (a, b): columns ``node``, ``root``.

    Alternating large-star and small-star rounds: each is an aggregation and a join on the node, so
    no component is gathered in one task and the edges never become more than they were.
    """
    now = cut(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _print(now)
    for _ in range(most_rounds):
        twin = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = twin.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = twin.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))
        now = cut(spark, large.join(low, "a").select(moved.alias("e")).select("e.*").where("a <> b").distinct())
        after = _print(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
