"""JSON documents as VARIANT rows: ``pos``, ``doc``."""

from __future__ import annotations

import functools
import io
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Characters that a stream is read by, and documents of a batch.
STEP, ROWS = 1 << 20, 256


def elements(text: Iterator[str]) -> Iterator[str]:
    """The elements, as JSON, of an array that comes in parts; never more than one of them is held."""
    decoder, held, at, inside = json.JSONDecoder(), "", 0, False
    for part in itertools.chain(text, [None]):
        if part is not None:
            held, at = held[at:] + part, 0
        while True:
            while at < len(held) and held[at] in " \t\r\n,":
                at += 1
            if at == len(held):
                break
            if not inside:
                if held[at] != "[":
                    raise ValueError("not a JSON array")
                inside, at = True, at + 1
                continue
            if held[at] == "]":
                return
            try:
                _, end = decoder.raw_decode(held, at)
            except json.JSONDecodeError:
                if part is None:
                    raise
                break  # the element goes on in the next part
            if end == len(held) and part is not None:
                break  # a number may go on
            yield held[at:end]
            at = end
    raise ValueError("the array does not end")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a file, or of the files of a folder, that hold one JSON array each.

    A task reads its file as a stream, so neither a file nor its array must fit a value.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(at) as raw:
                    found = elements(iter(functools.partial(io.TextIOWrapper(raw, encoding="utf-8").read, STEP), ""))
                    first = 0
                    while some := list(itertools.islice(found, ROWS)):
                        yield pa.record_batch({"file": [uri] * len(some), "nth": pa.array(range(first, first + len(some)), pa.int64()), "j": pa.array(some, pa.string())})
                        first += len(some)

    files = spark.read.format("binaryFile").load(path).select("path").distinct()  # names alone; the contents are not read
    rows = files.mapInArrow(scan, "file string, nth long, j string")
    return _placed(rows, "file", "nth").select("pos", F.parse_json("j").alias("doc"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: the form for large libraries, whose files are split among tasks."""
    lines = spark.read.text(path).select("value", F.concat_ws("|", "_metadata.file_path", F.format_string("%020d", "_metadata.file_block_start")).alias("block"))
    lines = lines.withColumn("nth", F.monotonically_increasing_id()).where(F.length(F.trim("value")) > 0)
    return _placed(lines, "block", "nth").select("pos", F.parse_json("value").alias("doc"))


def _placed(rows: DataFrame, part: str, nth: str) -> DataFrame:
    """``rows`` with ``pos``, their number in the order of parts and, in a part, of ``nth``; the same however tasks are cut."""
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(part).orderBy(nth)) - 1)
    sizes = rows.groupBy(part).agg(F.count("*").alias("_n"))  # a row a part
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, part).withColumn("pos", F.col("_base") + F.col("_in"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file or folder: an array a file, or a document a line, as its first character tells."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.substring(F.ltrim("value"), 1, 1)).first()
    return read_lines(spark, path) if first and first[0] == "{" else read_array(spark, path)


def from_objects(spark: SparkSession, docs: list[dict]) -> DataFrame:
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "pos long, j string").select("pos", F.parse_json("j").alias("doc"))


def after(docs: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` behind ``docs``."""
    last = docs.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    return docs.unionByName(more.withColumn("pos", F.col("pos") + last))


def classify(docs: DataFrame) -> str:
    """``items`` if all have an item type, else ``collections`` if all have a name; an empty list is items."""
    has = lambda path: F.coalesce(F.bool_and(F.expr(f"variant_get(doc, '{path}', 'variant') IS NOT NULL")), F.lit(True))
    items, collections = docs.agg(has("$.data.itemType"), has("$.data.name")).first()
    if items:
        return "items"
    if collections:
        return "collections"
    raise ValueError("neither all items nor all collections")


def write_lines(docs: DataFrame, path: str) -> None:
    """A folder of files with a document a line, which ``read`` takes."""
    docs.select(F.to_json("doc").alias("value")).write.mode("overwrite").text(path)
