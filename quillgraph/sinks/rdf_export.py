"""RDF syntaxes of a quad table, a line or a block a row, written by ``write``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms
from ..functions.iri import prefixes as export_prefixes

#: Format names and their file extensions.
FORMATS = {"trig": "trig", "nquads": "nq", "ttl": "ttl", "nt": "nt", "n3": "n3", "xml": "rdf"}
NAMED_GRAPHS = ("trig", "nquads")


def escape(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _iri(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for name, ns in (prefixes or {}).items():
        local = F.substring(c, len(ns) + 1, 1 << 20)
        # the longest namespace wins: it is tried last and so stands outermost
        out = F.when(c.startswith(ns) & local.rlike(r"^[A-Za-z_][\w\-]*\z"), F.concat(F.lit(name + ":"), local)).otherwise(out)
    return out


def subject(prefixes: dict[str, str] | None = None) -> Column:
    return F.when(F.col("s_kind") == "bnode", F.col("s")).otherwise(_iri(F.col("s"), prefixes))


def object_(prefixes: dict[str, str] | None = None) -> Column:
    quoted = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'))
    lit = F.when(F.col("o_lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNotNull(), F.concat(quoted, F.lit("^^"), _iri(F.col("o_dt"), prefixes))).otherwise(quoted)
    return F.when(F.col("o_kind") == "bnode", F.col("o")).when(F.col("o_kind") == "iri", _iri(F.col("o"), prefixes)).otherwise(lit)


def n_lines(quads: DataFrame, graphs: bool) -> DataFrame:
    """N-Quads lines, or N-Triples without ``graphs``."""
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), _iri(F.col("g")))).otherwise(F.lit("")) if graphs else F.lit("")
    return quads.select(F.concat(subject(), F.lit(" "), _iri(F.col("p")), F.lit(" "), object_(), g, F.lit(" .")).alias("value"))


def turtle_blocks(quads: DataFrame, prefixes: dict[str, str], graphs: bool) -> DataFrame:
    """A block a subject (and graph), predicates and objects in order."""
    p = F.when(F.col("p") == terms.TYPE, F.lit("a")).otherwise(_iri(F.col("p"), prefixes))
    one = quads.select("g", subject(prefixes).alias("s"), p.alias("p"), object_(prefixes).alias("o"))
    by = ["g", "s"] if graphs else ["s"]
    pairs = one.groupBy(*by, "p").agg(F.array_join(F.sort_array(F.collect_set("o")), " , ").alias("os"))
    body = pairs.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("p"), F.lit(" "), F.col("os")))), " ;\n    ").alias("body"))
    block = F.concat(F.col("s"), F.lit(" "), F.col("body"), F.lit(" ."))
    if not graphs:
        return body.select(block.alias("value"))
    return body.select(F.when(F.col("g").isNull(), block).otherwise(F.concat(_iri(F.col("g"), prefixes), F.lit(" {\n"), block, F.lit("\n}"))).alias("value"))


def _xml_escape(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    # characters that XML 1.0 cannot hold at all
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "�")


def xml_blocks(quads: DataFrame) -> DataFrame:
    """A description a subject. Each property declares the namespace of its own name."""
    ns, local = F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w\-]*)\z", 1), F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w\-]*)\z", 2)
    # the shortest prefix that leaves a name would cut words: take all after the last sign that no name holds
    ns, local = F.regexp_extract("p", r"^(.*[^\w\-]|)[\d\-]*([A-Za-z_][\w\-]*)\z", 1), F.regexp_extract("p", r"^(?:.*[^\w\-]|)[\d\-]*([A-Za-z_][\w\-]*)\z", 1)
    open_ = F.concat(F.lit("<p:"), local, F.lit(' xmlns:p="'), _xml_escape(ns), F.lit('"'))
    node = lambda c: F.substring(c, 3, 1 << 20)
    text = F.concat(F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).when(F.col("o_dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml_escape(F.col("o_dt")), F.lit('"'))).otherwise(F.lit("")), F.lit(">"), _xml_escape(F.col("o")), F.lit("</p:"), local, F.lit(">"))
    value = F.when(F.col("o_kind") == "iri", F.concat(F.lit(' rdf:resource="'), _xml_escape(F.col("o")), F.lit('"/>'))).when(F.col("o_kind") == "bnode", F.concat(F.lit(' rdf:nodeID="'), node(F.col("o")), F.lit('"/>'))).otherwise(text)
    one = quads.select("s", "s_kind", F.concat(open_, value).alias("e"))
    body = one.groupBy("s", "s_kind").agg(F.array_join(F.sort_array(F.collect_set("e")), "\n  ").alias("b"))
    about = F.when(F.col("s_kind") == "bnode", F.concat(F.lit('rdf:nodeID="'), node(F.col("s")), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), _xml_escape(F.col("s")), F.lit('"')))
    return body.select(F.concat(F.lit("<rdf:Description "), about, F.lit(">\n  "), F.col("b"), F.lit("\n</rdf:Description>")).alias("value"))


def export(quads: DataFrame, format: str, graph: str | None = None, vocab: str = "http://example.org/vocab#") -> tuple[DataFrame, str, str]:
    """(blocks, head, foot) of an export. Formats without graphs take one graph, or else the default graph."""
    if format not in FORMATS:
        raise ValueError(f"unsupported export format {format!r}")
    if graph is not None:
        quads = quads.where(F.col("g") == graph)
    elif format not in NAMED_GRAPHS:
        quads = quads.where("g IS NULL")
    quads = terms.as_set(quads)
    if format in ("nt", "nquads"):
        return n_lines(quads, format == "nquads"), "", ""
    if format == "xml":
        return xml_blocks(quads), f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{terms.RDF}">', "</rdf:RDF>"
    prefixes = dict(sorted(export_prefixes(vocab).items(), key=lambda x: len(x[1])))
    head = "\n".join(f"@prefix {k}: <{v}> ." for k, v in prefixes.items())
    return turtle_blocks(quads, prefixes, format == "trig"), head, ""


def write(quads: DataFrame, path: str, format: str, graph: str | None = None, vocab: str = "http://example.org/vocab#") -> None:
    """Writes an export as text files under ``path``, which in order make one document."""
    blocks, head, foot = export(quads, format, graph, vocab)
    if not head:
        blocks.write.mode("overwrite").text(path)
        return
    spark = quads.sparkSession
    edge = lambda k, text: spark.createDataFrame([(k, text)] if text else [], "k int, value string")
    rows = edge(0, head).unionByName(blocks.select(F.lit(1).alias("k"), "value")).unionByName(edge(2, foot))
    rows.repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)
