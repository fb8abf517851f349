"""An ontology graph from a type schema: classes, properties, domains, ranges, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms
from ..functions.iri import expand

SCHEMA = (
    "locales map<string,struct<itemTypes:map<string,string>,creatorTypes:map<string,string>,fields:map<string,string>>>,"
    "itemTypes array<struct<itemType:string,fields:array<struct<field:string,baseField:string>>,creatorTypes:array<struct<creatorType:string>>>>"
)
#: Classes that the schema does not list.
MAIN_CLASSES = ("item", "library", "collection", "tag", "creatorRole")


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """The schema document: one row. ``path``: a file, or an http address, which the driver fetches."""
    if path.startswith("http"):
        from ..sources.http_pages import get

        text = spark.createDataFrame([(get(path).decode(),)], "j string")
        return text.select(F.from_json("j", SCHEMA).alias("x")).select("x.*")
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def rdf_list(df: DataFrame, head: Column, elements: Column, g: str) -> DataFrame:
    """first and rest quads of the list of ``elements`` (IRIs) whose first node is ``head``."""
    rows = df.select(head.alias("head"), F.size(elements).alias("n"), F.posexplode(elements).alias("at", "x"))
    cell = lambda at: F.when(at == 0, F.col("head")).otherwise(terms.skolem(F.col("head"), at))
    here, after = cell(F.col("at")), cell(F.col("at") + 1)
    rest = F.when(F.col("at") + 1 < F.col("n"), terms.bnode(after)).otherwise(terms.iri(terms.RDF + "nil"))
    return terms.union(terms.quads(rows, here, terms.RDF + "first", terms.iri(F.col("x")), g, "bnode"), terms.quads(rows, here, terms.RDF + "rest", rest, g, "bnode"))


def union_of(df: DataFrame, s: Column, p: str, types: Column, g: str) -> DataFrame:
    """One type directly; several as a class that is the union of a list. ``types``: array of IRIs."""
    rows = df.select(s.alias("s"), types.alias("types")).where(F.size("types") > 0)
    one, many = rows.where(F.size("types") == 1), rows.where(F.size("types") > 1)
    node = terms.skolem(g, F.col("s"), p, F.to_json("types"))
    many = many.withColumn("node", node).withColumn("head", terms.skolem(F.col("node"), "list"))
    return terms.union(
        terms.quads(one, F.col("s"), p, terms.iri(F.col("types")[0]), g),
        terms.quads(many, F.col("s"), p, terms.bnode(F.col("node")), g),
        terms.quads(many, F.col("node"), terms.TYPE, terms.iri(terms.OWL + "Class"), g, "bnode"),
        terms.quads(many, F.col("node"), terms.OWL + "unionOf", terms.bnode(F.col("head")), g, "bnode"),
        rdf_list(many, F.col("head"), F.col("types"), g),
    )


def ontology(schema: DataFrame, vocab: str) -> DataFrame:
    """Quads of the ontology of a schema document (one row), in the graph of the vocabulary."""
    spark = schema.sparkSession
    g = vocab.strip("#/")
    name = lambda c: expand(c, vocab)
    locale = schema.select(F.explode("locales").alias("lang", "l"))
    labels = lambda *parts: [locale.select("lang", F.explode(f"l.{p}").alias("term", "label")) for p in parts]
    class_labels = labels("itemTypes", "creatorTypes")
    class_labels = class_labels[0].union(class_labels[1])
    field_labels = labels("fields")[0]
    types = schema.select(F.posexplode("itemTypes").alias("pos", "t")).select("pos", "t.*")
    fields = types.select("pos", "itemType", F.posexplode("fields").alias("fpos", "f")).select("pos", "fpos", "itemType", "f.*")
    roles = types.select("itemType", F.col("creatorTypes.creatorType").alias("roles")).where(F.size("roles") > 0)
    role = roles.select(F.explode("roles").alias("role")).distinct()
    main = spark.createDataFrame([(c,) for c in MAIN_CLASSES], "term string")
    # classes in sorted order, so the lists are the same in every run
    domains = fields.groupBy("field").agg(F.sort_array(F.collect_set("itemType")).alias("classes"))
    base = fields.where("baseField IS NOT NULL").groupBy("field").agg(F.max_by("baseField", F.struct("pos", "fpos")).alias("base"))
    owl, lang_label = terms.OWL, lambda: terms.literal(F.col("label"), None, F.col("lang"))
    creators = F.lit(vocab + "creators")
    return terms.as_set(terms.union(
        terms.quads(main, name(F.col("term")), terms.TYPE, terms.iri(owl + "Class"), g),
        terms.quads(main, name(F.col("term")), terms.LABEL, terms.literal(F.col("term")), g),
        terms.quads(types, name(F.col("itemType")), terms.TYPE, terms.iri(owl + "Class"), g),
        terms.quads(types, name(F.col("itemType")), terms.RDFS + "subClassOf", terms.iri(vocab + "item"), g),
        terms.quads(class_labels.join(types.select(F.col("itemType").alias("term")).union(role), "term", "left_semi"), name(F.col("term")), terms.LABEL, lang_label(), g),
        terms.quads(domains, name(F.col("field")), terms.TYPE, terms.iri(owl + "DatatypeProperty"), g),
        union_of(domains, name(F.col("field")), terms.RDFS + "domain", F.transform("classes", lambda c: name(c)), g),
        terms.quads(domains, name(F.col("field")), terms.RDFS + "range", terms.iri(terms.RDFS + "Literal"), g),
        terms.quads(field_labels.join(domains.select(F.col("field").alias("term")), "term", "left_semi"), name(F.col("term")), terms.LABEL, lang_label(), g),
        terms.quads(base, name(F.col("field")), owl + "equivalentProperty", terms.iri(name(F.col("base"))), g),
        terms.quads(role, name(F.col("role")), terms.TYPE, terms.iri(owl + "Class"), g),
        terms.quads(role, name(F.col("role")), terms.RDFS + "subClassOf", terms.iri(vocab + "creatorRole"), g),
        terms.quads(roles, creators, terms.TYPE, terms.iri(owl + "ObjectProperty"), g),
        terms.quads(roles, creators, terms.LABEL, terms.literal("Creators"), g),
        union_of(roles, creators, terms.RDFS + "range", F.transform("roles", lambda c: name(c)), g),
        union_of(roles, creators, terms.RDFS + "domain", F.array(name(F.col("itemType"))), g),
    ))
