"""Relational tables as quads, and the queries of the engine's operators over them.

Each query runs an operator on whole tables and returns plain columns; ``ORACLE_SQL`` has the same
result as SQL over the tables where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .functions.dates import date_literal, year
from .functions.iri import file_name, safe_iri
from .functions.text import language_code
from .operators import entities, notes
from .plans import algebra, sparql, visual
from .runtime import fresh_dir
from .sinks import csv_pivot, rdf_export
from .sinks.store import Store, graph_counts, pattern
from .sources import csv_quads, json_docs

B = "http://example.org/"
V = B + "vocab#"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{B}{kind}/"), F.col(key).cast("string"))


def unpivot(df: DataFrame, kind: str, key: str, links: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Quads of a table's rows, in a graph of its own. ``links``: column to the kind it refers to."""
    cells = []
    for c in df.columns:
        if c == key:
            continue
        if c in links:
            o = terms.iri(_iri(links[c], c))
        else:
            o = terms.literal(F.col(c).cast("string"), terms.XSD + "int" if c in numbers else None)
        cells.append(F.struct(F.lit(V + c).alias("p"), o.alias("x")))
    cells.append(F.struct(F.lit(terms.TYPE).alias("p"), terms.iri(V + kind).alias("x")))
    rows = df.select(_iri(kind, key).alias("s"), F.explode(F.array(*cells)).alias("c")).where("c.x.o IS NOT NULL AND c.x.o <> ''")
    return rows.select("s", F.lit("iri").alias("s_kind"), F.col("c.p").alias("p"), "c.x.*", F.lit(B + "graph/" + kind).alias("g")).select(terms.COLUMNS)


def nations(spark: SparkSession, d: str) -> DataFrame:
    return terms.union(
        unpivot(table(spark, d, "nation"), "nation", "n_nationkey", {"n_regionkey": "region"}),
        unpivot(table(spark, d, "region"), "region", "r_regionkey", {}),
    )


def shop(spark: SparkSession, d: str) -> DataFrame:
    """Customers, orders, nations and regions."""
    c = table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    o = table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))
    return terms.union(nations(spark, d), unpivot(c, "customer", "c_custkey", {"c_nationkey": "nation"}), unpivot(o, "order", "o_orderkey", {"o_custkey": "customer"}))


def data(quads: DataFrame) -> algebra.Dataset:
    return algebra.Dataset(quads, apart=True)


PREFIX = f"PREFIX v: <{V}> PREFIX rdfs: <{terms.RDFS}> PREFIX xsd: <{terms.XSD}> "


def ask(quads: DataFrame, text: str) -> DataFrame:
    return algebra.plain(sparql.query(data(quads), PREFIX + text))


# mapping

_CUSTOMER = "".join(
    f" UNION ALL SELECT '{B}customer/' || c_custkey AS s, '{V}{c}' AS p, {e} AS o, '{k}' AS o_kind, '{B}graph/customer' AS g FROM customer"
    for c, e, k in (("c_name", "c_name", "literal"), ("c_nationkey", f"'{B}nation/' || c_nationkey", "iri"), ("c_mktsegment", "c_mktsegment", "literal"), ("c_acctbal", "c_acctbal::DECIMAL(15,2)::VARCHAR", "literal"))
)[11:]


@query(_CUSTOMER + f" UNION ALL SELECT '{B}customer/' || c_custkey, '{terms.TYPE}', '{V}customer', 'iri', '{B}graph/customer' FROM customer")
def quads_from_customer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    return unpivot(c, "customer", "c_custkey", {"c_nationkey": "nation"}).select("s", "p", "o", "o_kind", "g")


_NS = "6ba7b8119dad11d180b400c04fd430c8"
_UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab',1+(('0x'||substr(h,17,1))::INT % 4),1)||substr(h,18,3)||'-'||substr(h,21,12)"


@query(
    f"WITH n AS (SELECT sha1(unhex('{_NS}') || encode('{B}kb')) AS h), ns AS (SELECT replace({_UUID}, '-', '') AS u FROM n), "
    f"x AS (SELECT DISTINCT p_brand AS label, 'brand' AS kind FROM part UNION SELECT DISTINCT p_type, 'type' FROM part), "
    f"y AS (SELECT label, kind, sha1(unhex(u) || encode(label)) AS h FROM x, ns) SELECT kind, label, '{B}kb/' || kind || '/' || {_UUID} AS node FROM y"
)
def uuid5_entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x = p.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("label")).union(p.select(F.lit("type"), "p_type")).distinct()
    return x.select("kind", "label", entities.entity_iri(F.lit(B + "kb"), F.col("kind"), F.col("label")).alias("node"))


@query(
    f"SELECT '{B}order/' || o_orderkey AS s, '{terms.LABEL}' AS p, coalesce(nullif(o_orderpriority, ''), 'NO TITLE') || ': ' || o_orderstatus || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS o FROM orders "
    f"UNION ALL SELECT '{B}order/' || o_orderkey, '{terms.TYPE}', '{V}' || t FROM (SELECT o_orderkey, unnest(['item', 'status' || o_orderstatus]) AS t FROM orders)"
)
def types_and_labels(spark: SparkSession, d: str) -> DataFrame:
    from .operators.mapping import type_quads

    o = table(spark, d, "orders")
    label = F.concat(F.coalesce(F.nullif("o_orderpriority", F.lit("")), F.lit("NO TITLE")), F.lit(": "), F.col("o_orderstatus"), F.lit(" ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(")"))
    rows = o.select(_iri("order", "o_orderkey").alias("subject"), label.alias("label"), F.parse_json(F.to_json(F.struct(F.concat(F.lit("status"), F.col("o_orderstatus")).alias("kind")))).alias("data"))
    return terms.union(terms.quads(rows, F.col("subject"), terms.LABEL, terms.literal(F.col("label")), B), type_quads(rows, "data", ["_item", "kind"], "item", V, B)).select("s", "p", "o")


@query(
    f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN regexp_extract('c. ' || strftime(o_orderdate, '%Y') || '?', '\\b(1[5-9]\\d\\d|20\\d\\d|2100)\\b', 1) ELSE 'undated' END AS o, "
    f"CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE '{terms.XSD}gYear' END AS o_dt FROM orders"
)
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    y = F.date_format("o_orderdate", "yyyy")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k == 1, y).when(k == 2, F.concat(F.lit("c. "), y, F.lit("?"))).otherwise(F.lit("undated"))
    rows = o.select("o_orderkey", text.alias("text")).withColumn("year", year(F.col("text")))
    x = date_literal(F.col("text"), F.lit(None).cast("string"))
    return rows.select("o_orderkey", x["o"].alias("o"), x["o_dt"].alias("o_dt"))


_PAIRS = """WITH RECURSIVE l AS (SELECT DISTINCT lower(p_type) AS label FROM part UNION SELECT DISTINCT lower(p_brand) FROM part),
pairs AS ({pairs}),
t(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) FROM pairs
UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN r[j] + 1 ELSE greatest(acc[j], r[j + 1]) END), [0::BIGINT]) FROM t WHERE i < length(a)),
s AS (SELECT a, b, 200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)) AS score FROM t WHERE i = length(a))
"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.lower("p_type").alias("label")).union(p.select(F.lower("p_brand"))).distinct()


@query(_PAIRS.format(pairs="SELECT x.label AS a, y.label AS b FROM l x JOIN l y ON x.label < y.label") + "SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 80")
def fuzzy_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different labels at the threshold."""
    return entities.similar(_labels(spark, d).withColumn("k", F.lit("x")), ["k"], 80.0).select("a", "b", F.round("score", 6).alias("score"))


_DROPPED = "regexp_replace(x.label, '[aeiou]([^aeiou]*)$', '\\1')"


@query(
    _PAIRS.format(pairs=f"SELECT DISTINCT {_DROPPED} AS a, y.label AS b FROM l x, l y")
    + ", q AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, md5(b)) AS n FROM s WHERE score >= 80) "
    + f"SELECT DISTINCT {_DROPPED} AS label, q.b AS matched, round(q.score, 6) AS score FROM l x LEFT JOIN q ON q.a = {_DROPPED} AND n = 1"
)
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The best known label for each misspelt one."""
    known = _labels(spark, d).select(F.lit("x").alias("k"), "label", F.concat(F.lit(B), F.md5("label")).alias("node"))
    asked = known.select("k", F.regexp_replace("label", "[aeiou]([^aeiou]*)$", "$1").alias("label"))
    return entities.best_match(asked, known, ["k"], 80.0).select("label", "matched", F.round("score", 6).alias("score"))


# basic graph patterns


@query("SELECT '%sorder/' || o_orderkey AS o, c_name AS name, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey" % B)
def bgp_chain(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), "SELECT ?o ?name ?region { ?o a v:order ; v:o_custkey ?c . ?c v:c_name ?name ; v:c_nationkey ?n . ?n v:n_regionkey ?r . ?r v:r_name ?region }")


@query("SELECT '%scustomer/' || c_custkey AS c, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'" % B)
def bgp_star(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?c ?name ?nation { ?c a v:customer ; v:c_name ?name ; v:c_mktsegment "BUILDING" ; v:c_nationkey ?n . ?n v:n_name ?nation }')


@query("SELECT c_name AS name, '%sorder/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'" % B)
def optional(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?name ?o { ?c v:c_name ?name OPTIONAL { ?o v:o_custkey ?c ; v:o_orderstatus "F" } }')


@query("SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def values(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?name ?region { VALUES ?region { "ASIA" "EUROPE" } ?r v:r_name ?region . ?n v:n_regionkey ?r . ?c v:c_nationkey ?n ; v:c_name ?name }')


@query("SELECT c_name AS name FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def minus(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?name { ?c v:c_name ?name MINUS { ?o v:o_custkey ?c ; v:o_orderstatus "P" } }')


@query("SELECT c_name AS name FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?name { ?c v:c_name ?name FILTER EXISTS { ?o v:o_custkey ?c ; v:o_orderstatus "P" } }')


@query("SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT n_name FROM nation")
def union(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?name { { ?c v:c_mktsegment "BUILDING" ; v:c_name ?name } UNION { ?n v:n_name ?name } }')


@query("SELECT c_mktsegment AS segment, n_name AS nation, count(*)::VARCHAR AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'n_1') GROUP BY ALL HAVING count(*) > 2")
def filter_group_having(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?segment ?nation (COUNT(*) AS ?n) { ?c v:c_mktsegment ?segment ; v:c_nationkey ?x . ?x v:n_name ?nation FILTER(CONTAINS(LCASE(?nation), "n_1")) } GROUP BY ?segment ?nation HAVING (COUNT(*) > 2)')


@query("SELECT n_name AS name, upper(substr(n_name, 1, 3)) || '-' || length(n_name) AS code FROM nation WHERE n_name SIMILAR TO '.*[AEIOU]{2}.*' ORDER BY name DESC LIMIT 7 OFFSET 1")
def bind_order_slice(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), 'SELECT ?name ?code { ?n v:n_name ?name FILTER REGEX(?name, "[aeiou]{2}", "i") BIND(CONCAT(UCASE(SUBSTR(?name, 1, 3)), "-", STR(STRLEN(?name))) AS ?code) } ORDER BY DESC(?name) LIMIT 7 OFFSET 1')


# paths


@query("SELECT '%snation/' || n_nationkey AS n, '%scustomer/' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey" % (B, B))
def path_inverse(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), "SELECT ?n ?c { ?n ^v:c_nationkey ?c }")


@query("SELECT '%sorder/' || o_orderkey AS o, '%sregion/' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey" % (B, B))
def path_seq(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), "SELECT ?o ?r { ?o v:o_custkey/v:c_nationkey/v:n_regionkey ?r }")


@query("SELECT '%scustomer/' || c_custkey AS c, x FROM (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS x FROM customer)" % B)
def path_alt(spark: SparkSession, d: str) -> DataFrame:
    return ask(shop(spark, d), "SELECT ?c ?x { ?c v:c_name|v:c_mktsegment ?x }")


def _ring(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers linked to another by arithmetic on their keys: chains that run into cycles."""
    s = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7 + 3) % 101 % 60).alias("next"))
    return unpivot(s, "supplier", "s_suppkey", {"next": "supplier"})


_EDGES = "WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 3) % 101 % 60 AS b FROM supplier)"


@query(f"{_EDGES}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT '{B}supplier/' || a AS a, '{B}supplier/' || b AS b FROM r")
def path_plus(spark: SparkSession, d: str) -> DataFrame:
    return ask(_ring(spark, d), "SELECT ?a ?b { ?a v:next+ ?b }")


@query(f"{_EDGES}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a) SELECT '{B}supplier/' || a AS a, '{B}supplier/' || b AS b FROM r")
def path_sym_plus(spark: SparkSession, d: str) -> DataFrame:
    return ask(_ring(spark, d), "SELECT ?a ?b { ?a (v:next|^v:next)+ ?b }")


@query(f"{_EDGES}, r AS (SELECT 5 AS b UNION SELECT e.b FROM r JOIN e ON r.b = e.a) SELECT '{B}supplier/' || b AS b FROM r")
def path_star_from(spark: SparkSession, d: str) -> DataFrame:
    return ask(_ring(spark, d), f"SELECT ?b {{ <{B}supplier/5> v:next* ?b }}")


# visual queries, facets, stores, sinks, sources


@query("SELECT DISTINCT '%scustomer/' || c_custkey AS \"Customer_1\" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND contains(lower(c_name), '7')" % B)
def visual_query(spark: SparkSession, d: str) -> DataFrame:
    q = {
        "distinct": True, "variables": ["Customer_1"], "order": None,
        "branches": [{"line": {"s": "?Customer_1", "p": V + "lives_in", "o": "?Region_2", "sType": V + "customer", "oType": V + "region", "values": [{"label": "", "rdfTerm": {"type": "uri", "value": B + "region/3"}}]}, "children": []},
                     {"line": {"s": "?Customer_1", "p": V + "c_name", "o": "?Name_3", "sType": V + "customer", "oType": None, "search": "7", "values": []}, "children": []}],
    }
    model = visual.Model({V + "lives_in": visual.Property([V + "c_nationkey", V + "n_regionkey"], "list", "link", "region"), V + "c_name": visual.Property(V + "c_name", "search", "text")})
    return algebra.plain(visual.run(data(shop(spark, d)), q, model, limit=None))


@query("SELECT c_mktsegment AS value, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return visual.facets(data(shop(spark, d)), V + "c_mktsegment")


@query("SELECT c_mktsegment AS value, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def facet_top_k(spark: SparkSession, d: str) -> DataFrame:
    return visual.facets(data(shop(spark, d)), V + "c_mktsegment", limit=3)


_GRAPHS = f"SELECT '{B}graph/nation' AS g, 3 * count(*) AS n FROM nation UNION ALL SELECT '{B}graph/region', 2 * count(*) FROM region"


@query(_GRAPHS)
def graph_listing(spark: SparkSession, d: str) -> DataFrame:
    return graph_counts(nations(spark, d))


@query(_GRAPHS)
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written, extended by what it holds, read again."""
    store = Store(spark, fresh_dir(spark, "store"))
    store.write(nations(spark, d))
    store.extend(nations(spark, d))
    store.optimize()
    return graph_counts(store.quads())


@query(f"SELECT '{B}nation/' || n_nationkey AS s, n_name AS o FROM nation")
def quad_pattern(spark: SparkSession, d: str) -> DataFrame:
    return pattern(nations(spark, d), p=V + "n_name", g=B + "graph/nation").select("s", "o")


@query(
    f"SELECT '{B}nation/' || n_nationkey AS iri, n_name AS name, '<{B}region/' || n_regionkey || '>' AS region, '' AS r_name, '<{V}nation>' AS type FROM nation "
    f"UNION ALL SELECT '{B}region/' || r_regionkey, '', '', r_name, '<{V}region>' FROM region"
)
def csv_pivot_table(spark: SparkSession, d: str) -> DataFrame:
    wide = csv_pivot.pivot(nations(spark, d))
    return wide.select(F.col("IRI").alias("iri"), F.col(f"`{V}n_name`").alias("name"), F.col(f"`{V}n_regionkey`").alias("region"), F.col(f"`{V}r_name`").alias("r_name"), F.col(f"`{terms.TYPE}`").alias("type"))


@query(
    f"SELECT '{B}nation/' || n_nationkey AS s, '{V}n_name' AS p, n_name || ' B' AS o, 'literal' AS o_kind FROM nation WHERE n_nationkey % 2 = 0 "
    f"UNION ALL SELECT '{B}nation/' || n_nationkey, '{V}n_name', n_name, 'literal' FROM nation UNION ALL SELECT '{B}nation/' || n_nationkey, '{V}n_regionkey', '{B}region/' || n_regionkey, 'iri' FROM nation WHERE n_nationkey % 2 = 1 "
    f"UNION ALL SELECT '{B}nation/' || n_nationkey, '{terms.TYPE}', '{V}nation', 'iri' FROM nation WHERE n_nationkey % 2 = 1"
)
def csv_roundtrip_delete(spark: SparkSession, d: str) -> DataFrame:
    """Even nations are deleted and loaded again from a CSV file with two names each."""
    quads = nations(spark, d).where(F.col("g") == B + "graph/nation")
    path = fresh_dir(spark, "csv")
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0")
    rows = n.select(_iri("nation", "n_nationkey").alias("IRI"), F.concat("n_name", F.lit(" | "), "n_name", F.lit(" B")).alias(V + "n_name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return csv_pivot.upsert(quads, csv_quads.read(spark, path), B + "graph/nation", delete_first=True).select("s", "p", "o", "o_kind")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') NOT IN ('0', '')")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    from .operators.mapping import fields

    e = table(spark, d, "events").select(F.col("event_id").alias("subject"), F.parse_json("props").alias("data"))
    return fields(e, "data", ["subject"]).where("field = 'k'").select(F.col("subject").alias("event_id"), F.col("s").alias("k"))


@query("SELECT * FROM (SELECT 'items' AS kind, count(*) AS n FROM orders)")
def json_classify(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.parse_json(F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.lit("order").alias("itemType")).alias("data")))).alias("doc"))
    kind = json_docs.classify(o)
    return o.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")


@query()
def note_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of the pages' HTML; there is no SQL form of an HTML parser."""
    p = table(spark, d, "pages").select(_iri("page", "page_id").alias("note"), F.col("html"))
    return notes.annotations(p).select("note", "id", "kind", "text", "structure")


@query(
    f"SELECT '<{B}nation/' || n_nationkey || '> <{V}n_name> \"' || n_name || '\" <{B}graph/nation> .' AS line FROM nation "
    f"UNION ALL SELECT '<{B}nation/' || n_nationkey || '> <{V}n_regionkey> <{B}region/' || n_regionkey || '> <{B}graph/nation> .' FROM nation "
    f"UNION ALL SELECT '<{B}nation/' || n_nationkey || '> <{terms.TYPE}> <{V}nation> <{B}graph/nation> .' FROM nation"
)
def nquads_export(spark: SparkSession, d: str) -> DataFrame:
    blocks, _, _ = rdf_export.export(nations(spark, d), "nquads", B + "graph/nation")
    return blocks.select(F.col("value").alias("line"))


@query(f"SELECT '{B}nation/' || n_nationkey AS s, '{V}n_name' AS p, n_name AS o FROM nation")
def turtle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as Turtle, RDF/XML and N-Triples and read again: the quads that all three give back."""
    from .sources import rdf_files

    quads = nations(spark, d)
    out = None
    for format, extension in (("ttl", "ttl"), ("xml", "rdf"), ("nt", "nt")):
        path = fresh_dir(spark, "rdf")
        rdf_export.write(quads.where(F.col("p") == V + "n_name").coalesce(1), path, format, B + "graph/nation", V)
        # the files of a folder in order are one document
        text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"))
        whole = text.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "value"))), lambda x: x["value"]), "\n").alias("t"))
        if extension == "nt":
            got = rdf_files.read(spark, path, "nt", graph=B)
        else:
            got = rdf_files.parse_files(whole.select(F.lit("x." + extension).alias("path"), F.encode("t", "UTF-8").alias("content")), B, B)
        got = got.select("s", "p", "o")
        out = got if out is None else out.intersect(got)
    return out


@query("SELECT code, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' ELSE 'und' END AS code FROM documents) GROUP BY code")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(language_code(F.col("lang")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT page_id, url AS iri FROM pages")
def safe_iris(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", safe_iri(F.col("url")).alias("iri"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/*([?#].*)?$', ''), '[^\\w.\\-]', '_', 'g') AS name FROM pages")
def iri_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", file_name(F.col("url")).alias("name"))


@query(f"SELECT '{B}nation/' || n_nationkey AS s, '{V}in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def construct(spark: SparkSession, d: str) -> DataFrame:
    return sparql.query(data(nations(spark, d)), PREFIX + "CONSTRUCT { ?n v:in ?name } WHERE { ?n v:n_regionkey/v:r_name ?name }").select("s", "p", "o")


@query("SELECT g, count(*)::VARCHAR AS n FROM (SELECT '%sgraph/nation' AS g FROM nation UNION ALL SELECT '%sgraph/region' FROM region) GROUP BY g" % (B, B))
def graph_variable(spark: SparkSession, d: str) -> DataFrame:
    return ask(nations(spark, d), "SELECT ?g (COUNT(?s) AS ?n) { GRAPH ?g { ?s a ?t } } GROUP BY ?g")


@query("SELECT n_regionkey::VARCHAR AS k, count(*)::VARCHAR AS n, min(n_name) AS lo, max(n_name) AS hi, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def sparql_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return ask(nations(spark, d), 'SELECT ?k (COUNT(DISTINCT ?n) AS ?n_) (MIN(?name) AS ?lo) (MAX(?name) AS ?hi) (GROUP_CONCAT(?name; SEPARATOR="|") AS ?names) { ?n v:n_regionkey ?r ; v:n_name ?name BIND(STRAFTER(STR(?r), "region/") AS ?k) } GROUP BY ?k').withColumnRenamed("n_", "n")


