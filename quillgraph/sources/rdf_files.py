"""RDF files as quads. N-Triples and N-Quads are read line by line with column expressions, so large
files split among tasks; the nested syntaxes are parsed a file a row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms

EXTENSIONS = ("rdf", "trig", "ttl", "nt", "nq")
_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]{4,8}[^<>\"{}|^`\\\x00-\x20]*)*)>"
_LINE = r"^\s*(?:" + _IRI + r"|(_:\S+))\s*" + _IRI + r"\s*(?:" + _IRI + r"|(_:[^\s.<]+(?:\.[^\s.<]+)*)|\"((?:[^\"\\]|\\.)*)\"(?:\^\^" + _IRI + r"|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*(?:" + _IRI + r"|(_:\S+))?\s*\.\s*(?:#.*)?$"


def _unescape(c: Column) -> Column:
    """Backslash escapes of a string; the numeric ones through JSON, which has the same form."""
    long_form = F.regexp_replace(c, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    as_json = F.concat(F.lit('["'), F.regexp_replace(F.replace(long_form, F.lit("\\'"), F.lit("'")), "[\\x00-\\x1f]", " "), F.lit('"]'))
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(F.from_json(as_json, "array<string>")[0], c)).otherwise(c)


def parse_lines(lines: DataFrame, scope: Column, graph: str | None) -> DataFrame:
    """Quads of N-Triples or N-Quads ``value`` lines; lines that are no statement give none."""
    at = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    ok = lines.where(F.col("value").rlike(_LINE)).select("value", scope.alias("scope"))
    bnode = lambda c: terms.skolem(F.col("scope"), c)
    is_literal = at(4).isNull() & at(5).isNull()
    dt = at(7)
    return ok.select(
        F.coalesce(_unescape(at(1)), bnode(at(2))).alias("s"),
        F.when(at(1).isNotNull(), "iri").otherwise("bnode").alias("s_kind"),
        _unescape(at(3)).alias("p"),
        F.when(is_literal, _unescape(F.regexp_extract("value", _LINE, 6))).when(at(4).isNotNull(), _unescape(at(4))).otherwise(bnode(at(5))).alias("o"),
        F.when(is_literal, "literal").when(at(4).isNotNull(), "iri").otherwise("bnode").alias("o_kind"),
        F.when(is_literal & (dt != terms.XSD + "string"), _unescape(dt)).alias("o_dt"),
        F.when(is_literal, at(8)).alias("o_lang"),
        F.coalesce(_unescape(at(9)), F.lit(graph).cast("string")).alias("g"),
    )


def parse_files(files: DataFrame, base: str, graph: str | None) -> DataFrame:
    """Quads of ``path``, ``content`` rows in Turtle, TriG or RDF/XML; a file that cannot be read fails."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .rdf_parser import parse

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(parse(content, path.rsplit(".", 1)[-1].lower(), base, path.rsplit("/", 1)[-1], graph))
                for a in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*rows[a : a + 10_000])], names=terms.COLUMNS)

    return files.select("path", "content").mapInArrow(read, ", ".join(f"{c} string" for c in terms.COLUMNS))


def read(spark: SparkSession, path: str | list[str], extension: str, base: str = "", graph: str | None = None) -> DataFrame:
    """Quads of a file, of several, or of all files that a pattern names. ``graph``: where triples go."""
    if extension in ("nt", "nq"):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
        return parse_lines(lines, F.col("file"), graph)
    return parse_files(spark.read.format("binaryFile").load(path), base, graph)


def read_directory(spark: SparkSession, directory: str, base: str = "", graph: str | None = None) -> tuple[DataFrame, list[str]]:
    """Quads of all RDF files of a directory, and the paths of its JSON files. Other files are skipped;
    a directory that does not exist has none."""
    jvm, out, json_files = spark._jvm, terms.empty(spark), []
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return out, json_files
    # a JSON dump is a folder of files
    found = sorted(str(x.getPath()) for x in fs.listStatus(path) if x.isFile() or x.getPath().getName().endswith(".json"))
    by: dict[str, list[str]] = {}
    for f in found:
        by.setdefault(f.rsplit(".", 1)[-1].lower(), []).append(f)
    for extension in EXTENSIONS:
        if by.get(extension):
            out = out.unionByName(read(spark, by[extension], extension, base, graph))
    return terms.as_set(out), by.get("json", [])
