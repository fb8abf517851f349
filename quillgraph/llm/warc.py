"""WARC archives as seekable Zstandard bundles.

Records are written in independent frames of about ``FRAME`` bytes; a skippable frame at a
bundle's end holds the seek table (the public Zstandard seekable format: compressed and
decompressed size of each frame). An index maps every record to its bundle, frame, and offset and
length within the decompressed frame, so one record costs one frame to read. A bundle counts only
once its rows are in the index; what a lost task left behind is in no index.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id holds the
payload (response) and the others revisit it; smaller payloads are always responses.

Defined cases: a null page is an empty payload; a null url is written as an ``urn:`` of the record;
a null id is always a response and refers to nothing; rows that repeat the largest id are
responses each; other columns are ignored; an empty table gives no bundles and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FRAME = 1 << 20
LEVEL = 3
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, bundle string, frame int, offset long, length long"


class BundleWriter:
    """Appends records to frames; ``close`` writes the seek table."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.out, self.frame, self.packer = out, frame, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.table = [], 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length)."""
        if self.size and self.size + len(record) > self.frame:
            self._flush()
        at = (len(self.table), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        packed = self.packer.compress(b"".join(self.held))
        self.out.write(packed)
        self.table.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        end = file.seek(0, io.SEEK_END)
        file.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        file.seek(end - 9 - entry * count)
        raw = file.read(entry * count)
        self.sizes = [struct.unpack_from("<II", raw, k * entry) for k in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        return self.unpacker.decompress(self.file.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit holds no payload."""

    def urn(i):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"

    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": (url or urn(page_id)[1:-1]).replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": "" if page_id is None else page_id,
        "X-Payload-Length": len(payload),
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": urn(refers_to), "X-Refers-To-Page-Id": refers_to, "WARC-Profile": REVISIT_PROFILE}
        payload = b""
    head["Content-Length"] = len(payload)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], memoryview, int]:
    """(headers, payload, place behind the record) of the record at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines)
    body, size = end + 4, int(head["Content-Length"])
    return head, memoryview(raw)[body : body + size], body + size + 4


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them make four characters."""
    parts = [F.lpad(F.conv(F.substring(digest_hex, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", frame: int = FRAME) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as bundles under ``folder``; returns the index."""
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), base32(F.sha1(html)).alias("digest"))
    # digests that occur more than once and their holder; narrow, whatever the number of copies
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), base32(F.sha1(html)).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    held = held.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1").select("digest", "holder")
    # a table of known size: the planner sends it to all tasks if it is small, and no payload is shuffled then
    held = common.settle(spark, held)
    marked = rows.join(held, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("holder"), F.col("holder")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        out, path, index = None, f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst", []
        for batch in batches:
            for part in common.pieces(batch, "payload"):
                for row in part.to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = BundleWriter(fs.open_output_stream(common.filesystem(path)[1], compression=None), frame)
                    index.append((row["page_id"], path, *out.add(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], date))))
                if len(index) >= 50_000:
                    yield _index_batch(index)
                    index = []
        if out is not None:
            out.close()
        if index:
            yield _index_batch(index)

    return common.cut(spark, marked.mapInArrow(archive, _INDEX))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["page_id", "bundle", "frame", "offset", "length"])


def _row(raw: bytes, at: int) -> tuple[tuple, int]:
    head, payload, after = parse(raw, at)
    ident = int(head["X-Page-Id"]) if head["X-Page-Id"] else None
    if head["WARC-Type"] == "revisit":
        return (ident, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(head["X-Refers-To-Page-Id"])), after
    return (ident, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response", None), after


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles named in ``index``; digests of responses are computed anew."""
    bundles = index.select("bundle").distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                fs, at = common.filesystem(path)
                with fs.open_input_file(at) as f:
                    reader = BundleReader(f)
                    for k in range(len(reader.sizes)):
                        raw, at, out = reader.frame(k), 0, []
                        while at < len(raw):
                            row, at = _row(raw, at)
                            out.append(row)
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.repartition(max(1, bundles.count())).mapInArrow(scan, _READ)


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The raw records (``page_id``, ``record``) of ``ids`` (page_id): one frame each is read."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, reader, raw = (None, None), None, None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bundle"] != now[0]:
                    if file:
                        file.close()
                    fs, at = common.filesystem(row["bundle"])
                    file = fs.open_input_file(at)
                    reader = BundleReader(file)
                if (row["bundle"], row["frame"]) != now:
                    raw, now = reader.frame(row["frame"]), (row["bundle"], row["frame"])
                out.append(raw[row["offset"] : row["offset"] + row["length"]])
            yield pa.record_batch({"page_id": batch.column("page_id"), "record": pa.array(out, pa.binary())})
        if file:
            file.close()

    return wanted.mapInArrow(scan, "page_id long, record binary")
