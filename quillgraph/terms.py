"""The quad table: its schema, terms as columns, and set operations on it.

A quad is a row of four terms. Subjects are IRIs or blank nodes, predicates IRIs, objects IRIs, blank
nodes or literals with an optional datatype or language, and the graph an IRI or null (the default
graph). A store is a set, so ``as_set`` follows every union that can repeat a quad.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
TYPE, LABEL, ALT_LABEL = RDF + "type", RDFS + "label", SKOS + "altLabel"

COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "g"]
SCHEMA = T.StructType([T.StructField(c, T.StringType(), c in ("o_dt", "o_lang", "g")) for c in COLUMNS])
OBJECT = "struct<o:string,o_kind:string,o_dt:string,o_lang:string>"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iri(value) -> Column:
    return F.struct(_col(value).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def bnode(value) -> Column:
    return F.struct(_col(value).alias("o"), F.lit("bnode").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def literal(value, datatype=None, lang=None) -> Column:
    return F.struct(_col(value).alias("o"), F.lit("literal").alias("o_kind"), _col(datatype).cast("string").alias("o_dt"), _col(lang).cast("string").alias("o_lang"))


def skolem(*parts) -> Column:
    """A blank node that the same parts always give, so a task that runs twice makes no second node."""
    return F.concat(F.lit("_:b"), F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])), 1, 24))


def quads(df: DataFrame, s, p, obj: Column, g, s_kind="iri") -> DataFrame:
    """Quads from the rows of ``df``; rows whose object is null give none."""
    out = df.select(_col(s).alias("s"), _col(s_kind).alias("s_kind"), _col(p).alias("p"), obj.alias("_o"), _col(g).cast("string").alias("g"))
    out = out.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("_o").isNotNull() & F.col("_o.o").isNotNull())
    return out.select("s", "s_kind", "p", "_o.o", "_o.o_kind", "_o.o_dt", "_o.o_lang", "g")


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select(COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(COLUMNS))
    return out


def as_set(df: DataFrame) -> DataFrame:
    return df.select(COLUMNS).dropDuplicates()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Quads from rows of eight values, in the order of ``COLUMNS``; for small constant graphs."""
    return spark.createDataFrame(rows, SCHEMA) if rows else empty(spark)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Quads of ``left`` that are not in ``right``; null parts are equal to null parts."""
    on = None
    r = right.select([F.col(c).alias("_" + c) for c in COLUMNS])
    for c in COLUMNS:
        same = left[c].eqNullSafe(r["_" + c])
        on = same if on is None else on & same
    return left.join(r, on, "left_anti")


def uuid5(namespace, name: Column) -> Column:
    """Version 5 UUID of ``name``; ``namespace`` is a ``uuid.UUID`` or a column of one as text."""
    if isinstance(namespace, uuid.UUID):
        ns = F.unhex(F.lit(namespace.hex))
    else:
        ns = F.unhex(F.replace(namespace, F.lit("-"), F.lit("")))
    h = F.sha1(F.concat(ns, F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def entity_namespace(graph: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, graph)
