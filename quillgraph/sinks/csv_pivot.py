"""CSV of subjects by predicates, and its use for updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..sources import csv_quads

DELIMITER = csv_quads.DELIMITER


def pivot(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """``IRI`` and a column a predicate, in order; several values are joined, in order."""
    if graph is not None:
        quads = quads.where(F.col("g") == graph)
    value = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.col("o"))
    cells = quads.select(F.col("s").alias("IRI"), "p", value.alias("x"), "o_dt", "o_lang", "g").distinct()
    names = [r[0] for r in cells.select("p").distinct().orderBy("p").collect()]  # the header
    wide = cells.groupBy("IRI").pivot("p", names).agg(F.array_join(F.sort_array(F.collect_list("x")), DELIMITER))
    return wide.na.fill("").orderBy("IRI")


def write(quads: DataFrame, path: str, graph: str | None = None) -> None:
    # one header: rows of all subjects are ordered by range, and each file repeats it
    pivot(quads, graph).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


def delete(quads: DataFrame, table: DataFrame, graph: str | None = None) -> DataFrame:
    """``quads`` without those of the table's subjects (in one graph, or in all)."""
    gone = csv_quads.subjects(table).withColumnRenamed("s", "_s")
    on = quads["s"] == gone["_s"]
    return quads.join(gone, on if graph is None else on & quads["g"].eqNullSafe(F.lit(graph)), "left_anti")


def upsert(quads: DataFrame, table: DataFrame, graph: str | None = None, delete_first: bool = False, strict: bool = False) -> DataFrame:
    base = delete(quads, table, graph) if delete_first else quads
    return terms.as_set(terms.union(base, csv_quads.quads(table, graph, strict)))
