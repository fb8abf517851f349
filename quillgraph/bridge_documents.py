"""Relational rows as documents of a library, and the queries of the mapping over them.

Orders are items, nations and regions collections, each with the fields that the mapping's rules tell
apart. The SQL states each rule's result on its own; only the identifiers are shared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bridge, terms
from .bridge import V, query, table
from .config import Library
from .operators import entities, mapping, notes, ontology
from .plans import algebra, sparql, visual
from .runtime import fresh_dir, spread, written
from .sinks import rdf_export
from .sinks.store import Store, graph_counts
from .sources import json_docs, rdf_files

G = "http://shop.org/groups/1"
KB = "http://shop.org/kb"
HREF = "http://shop.org/groups/shop"
AS_OF = "2024-01-01T00:00:00+00:00"
SETTINGS = {
    "item_type": ["_item", "itemType"], "collection_type": ["_collection"], "named_library": "inLibrary", "fuzzy": 100,
    "additional": [{"property": terms.LABEL, "value": "name", "named_node": False}, {"property": terms.OWL + "sameAs", "value": "url", "named_node": True}, {"property": "origin", "value": "_orders", "named_node": False}],
}


def library(**settings) -> Library:
    return Library(name="Shop", base_url=G, knowledge_base_graph=KB, library_type="groups", library_id="1", map=SETTINGS | settings)


def _docs(rows: DataFrame, pos: str) -> DataFrame:
    about = F.struct(F.lit("Shop").alias("name"), F.lit("group").alias("type"), F.struct(F.struct(F.lit(HREF).alias("href")).alias("alternate")).alias("links"))
    # no generator here: places are read without making documents
    return rows.select(F.col(pos).cast("long").alias("pos"), F.parse_json(F.to_json(F.struct(F.col("data"), about.alias("library")))).alias("doc"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as item documents. Which rules a row meets follows from its keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    at, most = F.col("o_orderdate"), F.lit(None).cast("string")
    date = F.when(k % 4 == 0, F.date_format(at, "dd.MM.yyyy")).when(k % 4 == 1, F.date_format(at, "yyyy")).when(k % 4 == 2, "undated").otherwise("3.4.812")
    person = lambda role, first, last, name: F.struct(F.lit(role).alias("creatorType"), first.alias("firstName"), last.alias("lastName"), name.alias("name"))
    first = person("author", F.concat(F.lit("F"), text(c % 10)), F.concat(F.lit("Clerk "), text(c % 100)), most)
    second = person("editor", most, most, F.concat(F.lit("Society "), text(c % 5)))
    deep = F.struct(text(k).alias("v"))
    for name in ("l5", "l4", "l3", "l2", "l1"):
        deep = F.struct(deep.alias(name))
    data = F.struct(
        text(k).alias("key"), F.concat(F.lit("order"), F.col("o_orderstatus")).alias("itemType"), F.col("o_orderpriority").alias("title"),
        F.when(k % 3 == 0, "german").when(k % 3 == 1, "").otherwise("klingon").alias("language"), date.alias("date"),
        text(k % 50).alias("numPages"), F.col("o_orderstatus").alias("volume"), F.array(F.concat(F.lit("C"), text(c % 25)), F.concat(F.lit("C"), text(c % 7))).alias("collections"),
        F.when(k % 5 == 0, text(k - 1)).alias("parentItem"), F.concat(F.lit("http://shop.org/o?id="), text(k), F.lit("&x=é ü")).alias("url"), F.concat(F.lit("10.1000/"), text(k)).alias("doi"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateAdded"), (k % 2 == 0).alias("archived"), (k % 3).alias("version"),
        F.when(k % 7 == 0, F.array(first, second)).otherwise(F.array(first)).alias("creators"), F.concat(F.lit("Port "), text(c % 20), F.lit(" ;; PORT "), text(k % 20)).alias("place"),
        F.array(F.struct(F.col("o_orderpriority").alias("tag"), (c % 3).alias("type"))).alias("tags"), F.when(k % 11 == 0, deep).alias("relations"),
    )
    return _docs(spread(table(spark, d, "orders"), "o_orderkey").withColumn("data", data), "o_orderkey")


def collections(spark: SparkSession, d: str) -> DataFrame:
    """Regions, and nations in them, as collection documents."""
    text = lambda x: F.col(x).cast("string")
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("pos"), F.struct(F.concat(F.lit("N"), text("n_nationkey")).alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("R"), text("n_regionkey")).alias("parentCollection")).alias("data"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.struct(F.concat(F.lit("R"), text("r_regionkey")).alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parentCollection")).alias("data"))
    return _docs(n.unionByName(r), "pos")


def mapped(spark: SparkSession, d: str, strict: bool = False, **settings) -> mapping.Mapped:
    return mapping.map_library(spark, library(**settings), V, items(spark, d), None, AS_OF, strict)


# the same in SQL

_NS = uuid.uuid5(uuid.NAMESPACE_URL, KB).hex
_IDS = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab',1+(('0x'||substr(h,17,1))::INT % 4),1)||substr(h,18,3)||'-'||substr(h,21,12)"


def _uuid(label: str) -> str:
    return f"list_transform([sha1(unhex('{_NS}') || encode({label}))], lambda h: {_IDS})[1]"


def _node(*parts: str) -> str:
    """A blank node's name."""
    return "'_:b' || substr(sha1(" + " || chr(31) || ".join(f"({p})" for p in (f"'{G}'", *parts)) + "), 1, 24)"


def _q(frm: str, s: str, p: str, o: str, kind: str = "literal", dt: str | None = None, lang: str = "NULL", g: str = G, s_kind: str = "iri") -> str:
    dt = f"'{terms.XSD}{dt}'" if dt else "NULL"
    return f"SELECT {s} AS s, '{s_kind}' AS s_kind, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {dt}::VARCHAR AS o_dt, {lang}::VARCHAR AS o_lang, '{g}' AS g FROM {frm}"


_ROWS = f"""i AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, o_orderpriority AS title, o_orderdate AS d, '{G}/items/' || o_orderkey AS s,
CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN 'undated' ELSE '3.4.812' END AS date,
CASE o_orderkey % 3 WHEN 0 THEN 'german' WHEN 2 THEN 'klingon' END AS language FROM orders)"""
_URL = "'http://shop.org/o?id=' || k || '&x=%C3%A9%20%C3%BC'"

#: What an item has whatever its fields' rules are.
_FRAME = [
    _q("i", "s", V + "inLibrary", f"'{HREF}'", "iri"),
    _q("i", "s", terms.LABEL, "'Clerk ' || c % 100 || ': ' || title || ' (' || date || ')'"),
    _q("i", "s", terms.TYPE, f"'{V}item'", "iri"),
    _q("i", "s", terms.TYPE, f"'{V}order' || status", "iri"),
    _q("i", "s", terms.OWL + "sameAs", _URL, "iri"),
    _q("i", "s", V + "origin", "'orders'"),
    _q("i", "s", terms.PROV + "generatedAtTime", f"'{AS_OF}'", dt="dateTime"),
    _q("region WHERE r_regionkey = 0", f"'{HREF}'", terms.TYPE, f"'{V}library'", "iri"),
    _q("region WHERE r_regionkey = 0", f"'{HREF}'", terms.LABEL, "'Shop'"),
    _q("region WHERE r_regionkey = 0", f"'{HREF}'", V + "origin", "'orders'"),
]


def _chain(frm: str, start: str, names: list[str], value: str) -> list[str]:
    """Nested objects as blank nodes, one in the other; the last name has the value."""
    out, at, kind = [], start, "iri"
    for name in names[:-1]:
        below = _node(at, f"'{name}'", "'0'")
        out.append(_q(frm, at, V + name, below, "bnode", s_kind=kind))
        at, kind = below, "bnode"
    return [*out, _q(frm, at, V + names[-1], value, s_kind="bnode")]


_ONE = "region WHERE r_regionkey = 0"
_PLAIN = [_q("i", "s", V + "key", "k::VARCHAR"), _q("i", "s", V + "itemType", "'order' || status"), _q("i WHERE k % 2 = 0", "s", V + "archived", "'True'"), _q("i WHERE k % 3 > 0", "s", V + "version", "(k % 3)::VARCHAR"),
          _q(_ONE, f"'{HREF}'", V + "name", "'Shop'"), _q(_ONE, f"'{HREF}'", V + "type", "'group'")]
_TITLED = [
    _q("i", "s", V + "title", "title", lang="CASE language WHEN 'german' THEN 'de' WHEN 'klingon' THEN 'und' END"),
    _q("i WHERE language IS NOT NULL", "s", V + "language", "CASE language WHEN 'german' THEN 'de' ELSE language END"),
]
_RULES = [
    *_PLAIN,
    _q("i WHERE k % 4 < 2", "s", V + "date", "strftime(d, '%Y')", dt="gYear"),
    _q("i WHERE k % 4 = 2", "s", V + "date", "'undated'"),
    _q("i WHERE k % 4 = 3", "s", V + "date", "'0812-04-03'", dt="dateTime"),
    _q("i", "s", V + "numPages", "(k % 50)::VARCHAR", dt="int"),
    _q("i", "s", V + "volume", "status"),
    _q("(SELECT s, unnest([c % 25, c % 7]) AS x FROM i)", "s", V + "collections", f"'{G}/collections/C' || x", "iri"),
    _q("i WHERE k % 5 = 0", "s", V + "parentItem", f"'{G}/items/' || (k - 1)", "iri"),
    _q("i", "s", V + "url", _URL, "iri"),
    _q("i", "s", V + "doi", "'https://doi.org/10.1000/' || k", "iri"),
    _q("i", "s", V + "dateAdded", "strftime(d, '%Y-%m-%dT%H:%M:%SZ')", dt="dateTime"),
]
_NESTED = _chain("i WHERE k % 11 = 0", "s", ["relations", "l1", "l2", "l3", "l4", "l5", "v"], "k::VARCHAR") + _chain(_ONE, f"'{HREF}'", ["links", "alternate", "href"], f"'{HREF}'")


def _union(parts: list[str]) -> str:
    return f"WITH {_ROWS} " + " UNION ".join(parts)


@query(_union(_FRAME + _RULES + _TITLED + _NESTED))
def map_items(spark: SparkSession, d: str) -> DataFrame:
    """Items' own quads: the dispatch by field, types, labels, extra properties, the library, provenance."""
    return mapped(spark, d).distinct()


@query(_union([*_FRAME, *_RULES, _q("i WHERE language IS NULL", "s", V + "title", "title")]))
def map_items_strict(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d, strict=True).distinct()


_FRAME_ONLY = "', '".join([V + "inLibrary", terms.LABEL, terms.TYPE, terms.OWL + "sameAs", V + "origin", terms.PROV + "generatedAtTime"])


@query(f"FROM ({_union(_FRAME + _RULES + _TITLED)}) WHERE p IN ('{_FRAME_ONLY}', '{V}title', '{V}date')")
def map_white_list(spark: SparkSession, d: str) -> DataFrame:
    """The white list holds; a black list beside it does not."""
    return mapped(spark, d, white=["title", "date"], black=["date"]).distinct()


@query(f"FROM ({_union(_FRAME + _RULES + _TITLED)}) WHERE p NOT IN ('{V}doi', '{V}numPages', '{V}name')")
def map_black_list(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d, black=["doi", "numPages", "name", "relations", "links"]).distinct()


@query(
    _union([
        *_FRAME, *_PLAIN, _q("i", "s", V + "title", "title"), _q("i WHERE language IS NOT NULL", "s", V + "language", "language"), _q("i", "s", V + "date", "date"),
        _q("i", "s", V + "numPages", "(k % 50)::VARCHAR", dt="int"), _q("(SELECT s, unnest([c % 25, c % 7]) AS x FROM i)", "s", V + "collections", "'C' || x"), _q("i WHERE k % 5 = 0", "s", V + "parentItem", "(k - 1)::VARCHAR"),
        _q("i", "s", V + "url", "'http://shop.org/o?id=' || k || '&x=é ü'"), _q("i", "s", V + "doi", "'10.1000/' || k"), _q("i", "s", V + "dateAdded", "strftime(d, '%Y-%m-%dT%H:%M:%SZ')"), _q("i", "s", V + "place", "'Port ' || c % 20 || ' ;; PORT ' || k % 20"),
    ])
)
def map_listed_fields(spark: SparkSession, d: str) -> DataFrame:
    """With listed fields all others are plain text; a listed number keeps its rule, a listed text is an entity."""
    return mapped(spark, d, rdf_mapping=["numPages", "volume"]).distinct()


@query(
    "WITH n AS (SELECT 'N' || n_nationkey AS key, n_name AS name, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, NULL FROM region), "
    f"x AS (SELECT *, '{G}/collections/' || key AS s FROM n) "
    + " UNION ".join([
        _q("x", "s", terms.TYPE, f"'{V}collection'", "iri"), _q("x", "s", terms.LABEL, "name"), _q("x", "s", V + "origin", "'orders'"), _q("x", "s", V + "key", "key"), _q("x", "s", V + "name", "name"), _q("x", "s", V + "inLibrary", f"'{HREF}'", "iri"),
        _q("x", "s", terms.PROV + "generatedAtTime", f"'{AS_OF}'", dt="dateTime"), _q("x WHERE parent IS NOT NULL", "s", V + "parentCollection", f"'{G}/collections/' || parent", "iri"),
        *_FRAME[-3:], *_PLAIN[-2:], *_chain(_ONE, f"'{HREF}'", ["links", "alternate", "href"], f"'{HREF}'"),
    ])
)
def map_collections(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_library(spark, library(), V, None, collections(spark, d), AS_OF).distinct()


@query(f"WITH {_ROWS} SELECT '_:b' || substr(sha1(('{G}') || chr(31) || s || chr(31) || 'relations' || chr(31) || '0'), 1, 24) AS top, k::VARCHAR AS v FROM i WHERE k % 11 = 0")
def nested_objects(spark: SparkSession, d: str) -> DataFrame:
    """The innermost value of six nested objects, by a path through their blank nodes."""
    path = "/".join(f"v:{x}" for x in ("l1", "l2", "l3", "l4", "l5", "v"))
    # each step of the path reads the quads again, so those of its predicates are written first
    quads = mapped(spark, d).quads.where(F.col("p").isin(*[V + x for x in ("relations", "l1", "l2", "l3", "l4", "l5", "v")]))
    return bridge.ask(written(spark, quads), f"SELECT ?top ?v {{ ?item v:relations ?top . ?top {path} ?v }}")


_TAG = f"'{KB}/tag/' || " + _uuid("title")


@query(
    _union([_q("i", "s", V + "tags", _TAG, "iri")])
    + " UNION " + " UNION ".join([
        _q("i", _TAG, terms.TYPE, f"'{V}tag'", "iri", g=KB), _q("i", _TAG, terms.LABEL, "title", g=KB), _q("i", _TAG, V + "tag", "title", g=KB),
        _q("(SELECT title, arg_min(c % 3, k) AS kind FROM i GROUP BY title) WHERE kind > 0", _TAG, V + "type", "kind::VARCHAR", g=KB),
    ])
)
def tag_entities(spark: SparkSession, d: str) -> DataFrame:
    """Tags by identity; their own fields are those of the first mention."""
    return terms.as_set(entities.tag_quads(mapped(spark, d).tags, V))


_PEOPLE = """, m AS (SELECT s, k, 0 AS nth, 'author' AS role, 'Clerk ' || c % 100 || ', F' || c % 10 AS label, 'Clerk ' || c % 100 AS lastName, 'F' || c % 10 AS firstName, NULL AS name FROM i
UNION ALL SELECT s, k, 1, 'editor', 'Society ' || c % 5, NULL, NULL, 'Society ' || c % 5 FROM i WHERE k % 7 = 0),
pl AS (SELECT s, k, 0 AS nth, 'Port ' || c % 20 AS label FROM i UNION ALL SELECT s, k, 1, 'PORT ' || k % 20 FROM i),
pf AS (SELECT lower(label) AS low, arg_min(label, k * 2 + nth) AS label FROM pl GROUP BY 1)"""
_PERSON = f"'{KB}/person/' || " + _uuid("label")
_PLACE = f"'{KB}/place/' || " + _uuid("label")
_ROLE = _node("s", "'creators'", "nth::VARCHAR")


def _creators(roles: str) -> str:
    """``roles``: the mentions whose role is told."""
    return f"WITH {_ROWS}{_PEOPLE} " + " UNION ".join([
        _q("m", "s", V + "creators", _ROLE, "bnode"), _q("m", _ROLE, terms.TYPE, f"'{V}creatorRole'", "iri", s_kind="bnode"), _q("m", _ROLE, V + "hasCreator", _PERSON, "iri", s_kind="bnode"),
        _q(roles, _ROLE, terms.LABEL, "role", s_kind="bnode"), _q(roles, _ROLE, V + "creatorType", f"'{V}' || role", "iri", s_kind="bnode"), _q(roles, _ROLE, terms.TYPE, f"'{V}' || role", "iri", s_kind="bnode"),
        _q("m", _PERSON, terms.TYPE, f"'{V}person'", "iri", g=KB), _q("m", _PERSON, terms.LABEL, "label", g=KB), _q("m", _PERSON, terms.ALT_LABEL, "label", g=KB),
        *[_q(f"m WHERE {x} IS NOT NULL", _PERSON, V + x, x, g=KB) for x in ("firstName", "lastName", "name")],
        _q("pf", _PLACE, terms.TYPE, f"'{V}place'", "iri", g=KB), _q("pf", _PLACE, terms.LABEL, "label", g=KB), _q("pf", _PLACE, terms.ALT_LABEL, "label", g=KB),
        _q("(SELECT pl.s, pf.label FROM pl JOIN pf ON lower(pl.label) = pf.low)", "s", V + "place", _PLACE, "iri"),
    ])


@query(_creators("m"))
def creator_entities(spark: SparkSession, d: str) -> DataFrame:
    """People with a role at each mention, and places split at semicolons, whose spellings differ in case."""
    return entities.entity_set(mapped(spark, d).mentions, V)


@query(_creators("(SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY k, nth) = 1)"))
def creator_entities_strict(spark: SparkSession, d: str) -> DataFrame:
    """A role is told only where its person is new."""
    return entities.entity_set(mapped(spark, d, strict=True).mentions, V, strict=True)


@query(f"WITH {_ROWS}{_PEOPLE} SELECT '{V}person' AS type, count(*)::VARCHAR AS n FROM m UNION ALL SELECT '{V}place', count(*)::VARCHAR FROM pl")
def unmatched_entities(spark: SparkSession, d: str) -> DataFrame:
    """A threshold over 100: each mention is an entity of its own."""
    quads = entities.entity_quads(mapped(spark, d, fuzzy=101).mentions, V)
    return bridge.ask(quads, f"SELECT ?type (COUNT(DISTINCT ?e) AS ?n) {{ ?e a ?type FILTER(STRSTARTS(STR(?e), '{KB}/')) }} GROUP BY ?type")


@query(
    "WITH RECURSIVE l AS (SELECT lower(p_brand || ' ' || p_type) AS label, min(p_partkey) AS r FROM part GROUP BY 1), n AS (SELECT label, row_number() OVER (ORDER BY r, label) AS i FROM l), "
    "pairs AS (SELECT x.label AS a, y.label AS b, x.i AS i, y.i AS j FROM n x JOIN n y ON y.i < x.i AND least(length(x.label), length(y.label)) * 105 >= greatest(length(x.label), length(y.label)) * 95), "
    "t(a, b, i, j, n, r) AS (SELECT a, b, i, j, 0, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) FROM pairs UNION ALL SELECT a, b, i, j, n + 1, "
    "list_reduce(range(1, length(b) + 1), lambda acc, k: list_append(acc, CASE WHEN substr(b, k, 1) = substr(a, n + 1, 1) THEN r[k] + 1 ELSE greatest(acc[k], r[k + 1]) END), [0::BIGINT]) FROM t WHERE n < length(a)), "
    "s AS (SELECT i, j, 200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)) AS score FROM t WHERE n = length(a)), "
    "best AS (SELECT i, list(j) AS js FROM (SELECT *, max(score) OVER (PARTITION BY i) AS top FROM s WHERE score >= 95) WHERE score = top GROUP BY i), "
    "steps AS (SELECT n.i, js FROM n LEFT JOIN best USING (i)), "
    "f(i, founders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT f.i + 1, list_append(founders, CASE WHEN js IS NULL THEN f.i + 1 ELSE list_min(list_transform(js, lambda j: founders[j])) END) FROM f JOIN steps ON steps.i = f.i + 1), "
    "done AS (SELECT founders FROM f ORDER BY i DESC LIMIT 1) SELECT n.label, o.label AS founder FROM n, done JOIN n o ON o.i = done.founders[n.i]"
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Brands with types as mentions, resolved in key order: each joins the best label before it, or founds an entity."""
    c = table(spark, d, "part").select(F.lit(KB).alias("kb"), F.lit("brand").alias("etype"), F.concat("p_brand", F.lit(" "), "p_type").alias("label"), F.col("p_partkey").alias("rank"))
    return entities.resolve(c, None, 95.0).select("label", "founder")


# notes

_HTML = "'<h1>' || replace(p_brand, '#', ' ') || '</h1><p>Made as <strong>' || p_type || '</strong> &amp; <em>size ' || p_size || '</em> #kind' || p_size || ' <code>' || p_partkey || '</code></p><pre><em>no</em></pre>'"
_ALL = {**notes.MAPPING, "IGNORE": {**notes.MAPPING["IGNORE"], "regex": ["#"]}}


def part_notes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey").select(F.concat(F.lit(bridge.B + "note/"), F.col("p_partkey").cast("string")).alias("note"), F.expr(_HTML).alias("html"))


@query(
    f"SELECT '{bridge.B}note/' || p_partkey AS note, unnest([{{'kind': 'Structure', 'text': b, 'inside': NULL, 'locator': NULL}}, {{'kind': 'Document', 'text': 'Made as ' || p_type || ' & size ' || p_size || ' kind' || p_size || ' ' || p_partkey, 'inside': b, 'locator': NULL}}, "
    "{'kind': 'Annotation', 'text': p_type, 'inside': b, 'locator': p_partkey::VARCHAR}, {'kind': 'Annotation', 'text': 'size ' || p_size, 'inside': b, 'locator': p_partkey::VARCHAR}, {'kind': 'Annotation', 'text': 'kind' || p_size, 'inside': b, 'locator': p_partkey::VARCHAR}, {'kind': 'Locator', 'text': p_partkey::VARCHAR, 'inside': b, 'locator': NULL}], recursive := true) FROM (SELECT *, replace(p_brand, '#', ' ') AS b FROM part)"
)
def note_layout(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of notes with the heading they lie under and their locator."""
    return notes.layout(part_notes(spark, d), _ALL)


_N = notes.NOTES
_RULE = {"domainTypes": _N + "Entity", "domainProperty": _N + "text", "rangeType": V + "kind", "targetProperty": terms.ALT_LABEL, "mapProperty": terms.OWL + "sameAs", "knowledgeBaseGraph": KB}


@query(
    f"WITH e AS (SELECT p_partkey, p_type AS label FROM part UNION ALL SELECT p_partkey, 'kind' || p_size FROM part), kb AS (SELECT DISTINCT p_type AS label FROM part WHERE p_size <= 10) "
    f"SELECT e.label, CASE WHEN kb.label IS NULL THEN '{KB}/semantic_html/' || {_uuid('e.label')} ELSE '{KB}/kind/' || md5(e.label) END AS node, count(*) AS n FROM e LEFT JOIN kb USING (label) GROUP BY ALL"
)
def knowledge_base_links(spark: SparkSession, d: str) -> DataFrame:
    """Notes' entities linked to the kinds that a knowledge base has, or to new nodes in it."""
    kinds = table(spark, d, "part").where("p_size <= 10").select("p_type").distinct()
    node = F.concat(F.lit(KB + "/kind/"), F.md5("p_type"))
    kb = terms.union(terms.quads(kinds, node, terms.TYPE, terms.iri(V + "kind"), KB), terms.quads(kinds, node, terms.ALT_LABEL, terms.literal(F.upper("p_type")), KB))
    # the annotations are written, their quads are not: each use reads the columns of its own predicates
    graph = notes.note_quads(written(spark, notes.annotations(part_notes(spark, d), _ALL)), G)
    links = notes.link_entities(graph, kb, [_RULE], KB, G, 100)
    same = links.where(F.col("p") == terms.OWL + "sameAs").select("s", F.col("o").alias("node"))
    label = graph.where(F.col("p") == _N + "text").select("s", F.col("o").alias("label"))
    return same.join(label, "s").groupBy("label", "node").agg(F.count("*").alias("n"))


# ontology

_TYPES = "t AS (SELECT DISTINCT replace(p_brand, '#', '_') AS class, regexp_extract(p_type, '^[A-Za-z]+') AS field FROM part), r AS (SELECT DISTINCT lower(c_mktsegment) AS role FROM customer)"


def schema_document(spark: SparkSession, d: str) -> DataFrame:
    """A type schema: brands as item types, the first words of their types as fields, segments as creators' types."""
    p = table(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("itemType"), F.regexp_extract("p_type", "^[A-Za-z]+", 0).alias("field")).distinct()
    fields = p.groupBy("itemType").agg(F.sort_array(F.collect_set(F.struct("field", F.when(F.col("field") != "ECONOMY", F.lit("ECONOMY")).alias("baseField")))).alias("fields"))
    roles = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("creatorType")).agg(F.sort_array(F.collect_set(F.struct("creatorType"))).alias("creatorTypes"))
    types = fields.crossJoin(F.broadcast(roles)).groupBy().agg(F.sort_array(F.collect_list(F.struct("itemType", "fields", "creatorTypes"))).alias("itemTypes"))  # one row of roles
    names = p.groupBy().agg(F.map_from_entries(F.collect_set(F.struct(F.col("itemType").alias("k"), F.concat(F.lit("Brand "), "itemType").alias("v")))).alias("itemTypes"), F.map_from_entries(F.collect_set(F.struct(F.col("field").alias("k"), F.initcap("field").alias("v")))).alias("fields"))
    none = F.lit(None).cast("map<string,string>")
    locales = names.select(F.create_map(F.lit("en"), F.struct(F.col("itemTypes"), none.alias("creatorTypes"), F.col("fields"))).alias("locales"))
    return spark.createDataFrame([], ontology.SCHEMA).unionByName(locales.crossJoin(types))


@query(
    f"WITH {_TYPES}, c AS (SELECT DISTINCT class FROM t), f AS (SELECT DISTINCT field FROM t) "
    f"SELECT '{V}' || x AS s, '{terms.TYPE}' AS p, '{terms.OWL}Class' AS o, NULL AS o_lang FROM (SELECT unnest(['item','library','collection','tag','creatorRole']) AS x UNION SELECT class FROM c UNION SELECT role FROM r) "
    f"UNION ALL SELECT '{V}' || x, '{terms.LABEL}', x, NULL FROM (SELECT unnest(['item','library','collection','tag','creatorRole']) AS x) "
    f"UNION ALL SELECT '{V}' || class, '{terms.RDFS}subClassOf', '{V}item', NULL FROM c UNION ALL SELECT '{V}' || role, '{terms.RDFS}subClassOf', '{V}creatorRole', NULL FROM r "
    f"UNION ALL SELECT '{V}' || class, '{terms.LABEL}', 'Brand ' || class, 'en' FROM c UNION ALL SELECT '{V}' || field, '{terms.LABEL}', upper(field[1]) || lower(field[2:]), 'en' FROM f "
    f"UNION ALL SELECT '{V}' || field, '{terms.TYPE}', '{terms.OWL}DatatypeProperty', NULL FROM f UNION ALL SELECT '{V}' || field, '{terms.RDFS}range', '{terms.RDFS}Literal', NULL FROM f "
    f"UNION ALL SELECT '{V}' || field, '{terms.OWL}equivalentProperty', '{V}ECONOMY', NULL FROM f WHERE field <> 'ECONOMY' "
    f"UNION ALL SELECT '{V}creators', '{terms.TYPE}', '{terms.OWL}ObjectProperty', NULL UNION ALL SELECT '{V}creators', '{terms.LABEL}', 'Creators', NULL"
)
def ontology_quads(spark: SparkSession, d: str) -> DataFrame:
    """Classes, properties, labels and base fields of a schema."""
    got = ontology.ontology(schema_document(spark, d), V).where("s_kind = 'iri' AND o_kind <> 'bnode'")
    told = F.col("p") == terms.RDFS + "domain"
    about_creators = (F.col("s") == V + "creators") & F.col("p").isin(terms.RDFS + "range")
    return got.where(~told & ~about_creators).select("s", "p", "o", "o_lang")


@query(
    f"WITH {_TYPES} SELECT '{V}' || field AS property, 'domain' AS what, '{V}' || class AS class FROM t "
    f"UNION ALL SELECT DISTINCT '{V}creators', 'domain', '{V}' || class FROM t UNION ALL SELECT '{V}creators', 'range', '{V}' || role FROM r"
)
def ontology_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains and ranges, those of several classes read off the lists of their unions."""
    got = ontology.ontology(schema_document(spark, d), V)
    prefix = f"PREFIX owl: <{terms.OWL}> PREFIX rdf: <{terms.RDF}> "
    member = "owl:unionOf/rdf:rest*/rdf:first"
    rows = [bridge.ask(got, f"{prefix} SELECT DISTINCT ?property ?class {{ {{ ?property rdfs:{what}/{member} ?class }} UNION {{ ?property rdfs:{what} ?class FILTER(ISIRI(?class)) }} }}").withColumn("what", F.lit(what)) for what in ("domain", "range")]
    return rows[0].unionByName(rows[1]).where(F.col("class") != terms.RDFS + "Literal")


# dumps, backups, sets


@query("SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS title FROM orders")
def json_dump_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents dumped into a directory, found there again, and taken in the same order."""
    folder = fresh_dir(spark, "dump")
    docs = items(spark, d)
    json_docs.write_lines(docs, f"{folder}/1_items.json")
    _, found = rdf_files.read_directory(spark, folder)
    back = json_docs.read(spark, found[0])
    got = back.join(docs.select("pos").withColumn("at", F.row_number().over(Window.orderBy("pos")) - 1).drop("pos"), F.col("pos") == F.col("at"))
    return got.select(F.expr("try_variant_get(doc, '$.data.key', 'string')").alias("key"), F.expr("try_variant_get(doc, '$.data.title', 'string')").alias("title"))


@query(f"SELECT '{bridge.B}graph/' || g AS g, n FROM (SELECT 'nation' AS g, 3 * count(*) + 1 AS n FROM nation UNION ALL SELECT 'region', 2 * count(*) - 1 FROM region)")
def store_backup(spark: SparkSession, d: str) -> DataFrame:
    """One quad more in a graph, one less in another, backed up; the backup's graphs."""
    quads = bridge.nations(spark, d)
    store = Store(spark, fresh_dir(spark, "store"))
    store.write(quads)
    store.extend(terms.from_rows(spark, [(bridge.B + "nation/0", "iri", V + "note", "x", "literal", None, None, bridge.B + "graph/nation")]))
    store.remove(quads.where((F.col("s") == bridge.B + "region/0") & (F.col("p") == terms.TYPE)))
    to = fresh_dir(spark, "backup")
    store.backup(to)
    return graph_counts(Store(spark, to).quads())


@query(f"SELECT '{bridge.B}nation/' || n_nationkey AS s, '{V}n_name' AS p, n_name AS o FROM nation")
def graph_formats(spark: SparkSession, d: str) -> DataFrame:
    """Written as TriG, N3 and N-Quads and read again: the names that all three give back."""
    quads, out = bridge.nations(spark, d).where(F.col("p") == V + "n_name"), None
    for form, extension in (("trig", "trig"), ("n3", "ttl"), ("nquads", "nq")):
        path = fresh_dir(spark, "rdf")
        rdf_export.write(quads.coalesce(1), path, form, bridge.B + "graph/nation", V)
        text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"))
        whole = text.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "value"))), lambda x: x["value"]), "\n").alias("t"))
        got = rdf_files.read(spark, path, "nq") if extension == "nq" else rdf_files.parse_files(whole.select(F.lit("x." + extension).alias("path"), F.encode("t", "UTF-8").alias("content")), bridge.B, bridge.B)
        out = got.select("s", "p", "o") if out is None else out.intersect(got.select("s", "p", "o"))
    return out


@query(f"SELECT '{bridge.B}nation/' || n_nationkey AS s, n_name AS o FROM nation WHERE n_regionkey <> 2")
def quad_difference(spark: SparkSession, d: str) -> DataFrame:
    """A set of quads without another's, null parts equal."""
    quads = bridge.nations(spark, d)
    less = bridge.unpivot(table(spark, d, "nation").where("n_regionkey = 2"), "nation", "n_nationkey", {"n_regionkey": "region"})
    return terms.difference(quads, less).where(F.col("p") == V + "n_name").select("s", "o")


@query("SELECT r_name AS region, count(*)::VARCHAR AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def union_default_graph(spark: SparkSession, d: str) -> DataFrame:
    """Patterns over all graphs as one set: triples that two graphs hold are met once."""
    quads = bridge.nations(spark, d)
    twice = terms.union(quads, quads.withColumn("g", F.lit(bridge.B + "graph/copy")), quads.withColumn("g", F.lit(None).cast("string")))
    return algebra.plain(sparql.query(algebra.Dataset(twice), bridge.PREFIX + "SELECT ?region (COUNT(?n) AS ?n_) { ?n v:n_regionkey ?r . ?r v:r_name ?region } GROUP BY ?region")).withColumnRenamed("n_", "n")


@query("SELECT p_brand AS brand, sum(p_size)::DOUBLE AS total, avg(p_size)::DOUBLE AS mean, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, count(DISTINCT p_size)::DOUBLE AS kinds FROM part GROUP BY 1")
def sparql_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    got = bridge.ask(bridge.unpivot(p, "part", "p_partkey", {}, ("p_size",)), "SELECT ?brand (SUM(?x) AS ?total) (AVG(?x) AS ?mean) (MIN(?x) AS ?lo) (MAX(?x) AS ?hi) (COUNT(DISTINCT ?x) AS ?kinds) { ?p v:p_brand ?brand ; v:p_size ?x } GROUP BY ?brand")
    return got.select("brand", *[F.col(c).cast("double").alias(c) for c in ("total", "mean", "lo", "hi", "kinds")])


@query("SELECT n_name AS name, r_name AS sample FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparql_sample(spark: SparkSession, d: str) -> DataFrame:
    return bridge.ask(bridge.nations(spark, d), "SELECT ?name (SAMPLE(?region) AS ?sample) { ?n v:n_name ?name ; v:n_regionkey ?r . ?r v:r_name ?region } GROUP BY ?name")


@query(f"SELECT '{bridge.B}nation/' || n_nationkey AS a, '{bridge.B}nation/' || n_nationkey AS b FROM nation UNION SELECT '{bridge.B}nation/' || n_nationkey, '{bridge.B}region/' || n_regionkey FROM nation")
def path_optional(spark: SparkSession, d: str) -> DataFrame:
    """Zero or one step from each nation."""
    return bridge.ask(bridge.nations(spark, d), "SELECT ?a ?b { ?a a v:nation . ?a v:n_regionkey? ?b }")


@query(f"SELECT '{bridge.B}nation/' || n_nationkey AS a, '{bridge.B}region/' || n_regionkey AS b FROM nation")
def path_negated(spark: SparkSession, d: str) -> DataFrame:
    """Any predicate but two."""
    return bridge.ask(bridge.nations(spark, d).where(F.col("g") == bridge.B + "graph/nation"), "SELECT ?a ?b { ?a !(v:n_name|a) ?b }")


@query("SELECT '%scustomer/' || c_custkey AS \"Customer_1\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3 ORDER BY 1 LIMIT 10" % bridge.B)
def visual_query_limit(spark: SparkSession, d: str) -> DataFrame:
    """The builder's query with its limit: the first rows by the shown variables."""
    line = {"s": "?Customer_1", "p": V + "lives_in", "o": "?Region_2", "sType": V + "customer", "oType": V + "region", "values": [{"label": "", "rdfTerm": {"type": "uri", "value": bridge.B + "region/3"}}]}
    model = visual.Model({V + "lives_in": visual.Property([V + "c_nationkey", V + "n_regionkey"], "list", "link", "region")})
    q = {"distinct": True, "variables": ["Customer_1"], "order": None, "branches": [{"line": line, "children": []}]}
    return algebra.plain(visual.run(bridge.data(bridge.shop(spark, d)), q, model, limit=10))


@query(f"SELECT '{bridge.B}region/' || r_regionkey AS value, 'Region ' || r_name AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def facet_labels(spark: SparkSession, d: str) -> DataFrame:
    """Facets of links, with the linked nodes' labels."""
    named = terms.quads(table(spark, d, "region"), F.concat(F.lit(bridge.B + "region/"), F.col("r_regionkey").cast("string")), terms.LABEL, terms.literal(F.concat(F.lit("Region "), "r_name")), bridge.B + "graph/region")
    return visual.facets(bridge.data(terms.union(bridge.nations(spark, d), named)), V + "n_regionkey")
