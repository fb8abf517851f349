"""CSV tables of subjects by predicates as quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms
from ..functions.iri import safe_iri

DELIMITER = " | "


def read(spark: SparkSession, path: str) -> DataFrame:
    # quotes are doubled in these files, and cells may hold line ends
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def subjects(table: DataFrame) -> DataFrame:
    name = F.trim(F.btrim(F.trim("IRI"), F.lit("<>")))
    return table.select(safe_iri(F.nullif(name, F.lit(""))).alias("s")).where("s IS NOT NULL").distinct()


def quads(table: DataFrame, graph: str | None = None, strict: bool = False) -> DataFrame:
    """Quads of a table: cells split at the delimiter. ``strict``: IRIs in brackets stay literals."""
    spark = table.sparkSession
    names = [c for c in table.columns if c != "IRI" and c.strip("<> ")]
    if not names:
        return terms.empty(spark)
    safe = {c: c.replace("`", "``") for c in names}
    cells = table.select("IRI", F.explode(F.array(*[F.struct(F.lit(c.strip("<>").strip()).alias("p"), F.col(f"`{safe[c]}`").cast("string").alias("cell")) for c in names])).alias("x")).select("IRI", "x.*")
    values = cells.where("cell IS NOT NULL").select("IRI", "p", F.explode(F.split("cell", r" \| ")).alias("v")).withColumn("v", F.trim("v")).where("v <> ''")
    s = safe_iri(F.nullif(F.trim(F.btrim(F.trim("IRI"), F.lit("<>"))), F.lit("")))
    bracketed = F.col("v").startswith("<") & F.col("v").endswith(">") & (F.length("v") > 2)
    obj = terms.literal(F.col("v")) if strict else F.when(bracketed, terms.iri(safe_iri(F.btrim("v", F.lit("<>"))))).otherwise(terms.literal(F.col("v")))
    return terms.as_set(terms.quads(values, s, safe_iri(F.col("p")), obj, graph))
