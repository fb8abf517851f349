"""Token ids as canonical, length-limited Huffman codes in files that decode in parallel.

Texts are dealt out by ranges of ``doc_id``; each task encodes its range in order into a spool file
and counts its ids. The counts of all tasks, one a vocabulary id, give the code lengths by the
package-merge method. A second pass turns each spool file into a file of groups:

    file    magic, vocabulary size, code lengths (zlib), groups, end mark
    group   documents, tokens, bytes of the parts | doc ids, tokens of each document (zlib) |
            bits of each block of 256 tokens (the checkpoints) | the code bits

The prefix sums of the checkpoints are the blocks' bit offsets; all blocks of a group decode side
by side through a table of 2^16 entries. Files in order of their number hold ascending doc ids.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of equal ids
are ordered by text; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LONGEST = 16
BLOCK = 256
GROUP_TOKENS = 1 << 20
#: Memory of the tokenizer's units that a worker keeps.
CACHE_BYTES = 224 << 20
MAGIC = b"QGHUFF1\n"
_GROUP = "<IQQQQ"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal code of at most ``longest`` bits; 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError("too many ids for the code length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64) if counts.sum() >= 2**62 else counts[order].astype(np.int64)
    row, leaves = leaf, []
    for _ in range(longest - 1):
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, packed])
        at = np.argsort(both, kind="stable")
        leaves.append(at < n)
        row = both[at]
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    lengths[order[:take]] += 1
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each id, ids in the order of their codes)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = (np.uint64(1) << (LONGEST - lengths[order]).astype(np.uint64)).astype(np.uint64)
    first = np.cumsum(width) - width
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = first >> (LONGEST - lengths[order]).astype(np.uint64)
    return codes, order


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next ``LONGEST`` bits."""
    _, order = canonical(lengths)
    width = 1 << (LONGEST - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << LONGEST, np.uint32), np.ones(1 << LONGEST, np.uint8)
    filled = int(width.sum())
    ids[:filled], size[:filled] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bits of each block, the code bits of ``ids``)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word, shift = start >> 6, 64 - (start & 63) - size
    code = codes[ids]
    kept = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    out = np.zeros((int(end[-1]) >> 6) + 2 if len(end) else 1, np.uint64)
    total = np.cumsum(kept)  # modulo 2^64; the codes of a word share no bit, so its sum is their union
    last = np.flatnonzero(np.diff(word, append=-1))
    out[word[last]] = np.diff(total[last], prepend=np.uint64(0))
    over = np.flatnonzero(shift < 0)
    out[word[over] + 1] += code[over] << (64 + shift[over]).astype(np.uint64)
    ends = end[BLOCK - 1 :: BLOCK]
    if len(end) % BLOCK:
        ends = np.append(ends, end[-1])
    blob = out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8 if len(end) else 0]
    return np.diff(ends, prepend=0).astype("<u2"), blob


def unpack(n: int, blocks: np.ndarray, blob: bytes, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a group; step k decodes the k-th token of every block."""
    ids, size = table
    bits = np.frombuffer(blob + b"\0\0\0", np.uint8)
    at = np.cumsum(blocks, dtype=np.int64) - blocks
    out = np.zeros((len(blocks), BLOCK), np.uint32)
    for k in range(min(BLOCK, n)):
        live = len(blocks) if k < (n - 1) % BLOCK + 1 else len(blocks) - 1
        p = at[:live]
        i = p >> 3
        window = (bits[i].astype(np.int32) << 16) | (bits[i + 1].astype(np.int32) << 8) | bits[i + 2]
        window = (window >> (8 - (p & 7))) & 0xFFFF
        out[:live, k] = ids[window]
        p += size[window]
    return out.reshape(-1)[:n]


def _write_group(f, docs: list[int | None], counts: list[int], body: bytes, blocks: bytes, tokens: int) -> None:
    known = np.array([x is not None for x in docs], np.uint8)
    names = zlib.compress(known.tobytes() + np.array([x or 0 for x in docs], "<i8").tobytes() + np.array(counts, "<u8").tobytes(), 1)
    f.write(struct.pack(_GROUP, len(docs), tokens, len(names), len(blocks), len(body)))
    f.write(names + blocks + body)


def _read_groups(f) -> Iterator[tuple[list[int | None], np.ndarray, int, bytes, bytes]]:
    while True:
        n, tokens, a, b, c = struct.unpack(_GROUP, f.read(struct.calcsize(_GROUP)))
        if not n:
            return
        names = zlib.decompress(f.read(a))
        known, docs, counts = np.frombuffer(names[:n], np.uint8), np.frombuffer(names[n : 9 * n], "<i8"), np.frombuffer(names[9 * n :], "<u8")
        yield [d if k else None for d, k in zip(docs.tolist(), known)], counts, tokens, f.read(b), f.read(c)


def encode(docs: DataFrame, folder: str, vocabulary: int, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, tokenizers: str | None = None) -> DataFrame:
    """Writes the corpus under ``folder``; returns ``part``, ``path``, ``n_docs``, ``n_tokens``, ``base`` of each file."""
    spark = docs.sparkSession

    def spool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from .tokens import encoder

        enc, part = encoder(tokenizer, tokenizers, cache_bytes=CACHE_BYTES), TaskContext.get().partitionId()
        counts, held, names, sizes, n_docs, total = np.zeros(vocabulary, np.int64), [], [], [], 0, 0
        tail, path, f = np.array([end_id], "<u4").tobytes(), f"{folder}/spool-{part:07d}-{uuid.uuid4().hex}", None
        fs, root = common.filesystem(folder)

        def flush():
            nonlocal f, held, names, sizes, n_docs, total
            ids = np.frombuffer(b"".join(held), "<u4")
            np.add(counts, np.bincount(ids, minlength=vocabulary), out=counts)
            if f is None:
                fs.create_dir(root, recursive=True)
                f = fs.open_output_stream(common.filesystem(path)[1])
            _write_group(f, names, sizes, zlib.compress(ids.astype("<u2").tobytes() if vocabulary <= 1 << 16 else ids.tobytes(), 1), b"", len(ids))
            n_docs, total = n_docs + len(names), total + len(ids)
            held, names, sizes = [], [], []

        room = 0
        for batch in batches:
            for piece in common.pieces(batch, "text"):
                for doc, ids in zip(piece.column("doc_id").to_pylist(), enc.ids(piece.column("text").to_pylist())):
                    held += [ids, tail]
                    names.append(doc)
                    sizes.append(len(ids) // 4 + 1)
                    room += sizes[-1]
                    if room >= GROUP_TOKENS:
                        flush()
                        room = 0
        if names:
            flush()
        if f is not None:
            f.write(struct.pack(_GROUP, 0, 0, 0, 0, 0))
            f.close()
            seen = np.flatnonzero(counts)
            yield pa.record_batch({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [total], "id": [-1], "n": [0]}, schema=spool_schema)
            yield pa.record_batch({"part": [part] * len(seen), "path": [""] * len(seen), "n_docs": [0] * len(seen), "n_tokens": [0] * len(seen), "id": seen.tolist(), "n": counts[seen].tolist()}, schema=spool_schema)

    spool_schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    spooled = common.cut(spark, ordered.mapInArrow(common.freed(spool), "part long, path string, n_docs long, n_tokens long, id long, n long"))
    counts = np.zeros(vocabulary, np.int64)
    for i, n in spooled.where("id >= 0").groupBy("id").agg(F.sum("n")).collect():  # one row an id of the vocabulary
        counts[i] = n
    lengths = code_lengths(counts)
    parts = spooled.where("id < 0").select("part", "path", "n_docs", "n_tokens")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _ = canonical(lengths)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                to = f"{folder}/tokens-{row['part']:07d}-{uuid.uuid4().hex}.huff"
                fs, source = common.filesystem(row["path"])
                with fs.open_input_stream(source) as old, fs.open_output_stream(common.filesystem(to)[1]) as new:
                    head = zlib.compress(lengths.tobytes(), 9)
                    new.write(MAGIC + struct.pack("<II", len(lengths), len(head)) + head)
                    for names, sizes, tokens, _, body in _read_groups(old):
                        ids = np.frombuffer(zlib.decompress(body), "<u2" if vocabulary <= 1 << 16 else "<u4")
                        blocks, bits = pack(ids, codes, lengths)
                        _write_group(new, names, sizes.tolist(), bits, blocks.tobytes(), tokens)
                    new.write(struct.pack(_GROUP, 0, 0, 0, 0, 0))
                out.append(to)
            yield pa.record_batch({"part": batch.column("part"), "path": pa.array(out), "n_docs": batch.column("n_docs"), "n_tokens": batch.column("n_tokens")})

    files = common.cut(spark, parts.repartition(max(1, parts.count())).mapInArrow(compress, "part long, path string, n_docs long, n_tokens long"))
    # one row a file; the spool files have been read for the last time
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    _remove(spark, parts.select("path"))
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _remove(spark: SparkSession, paths: DataFrame) -> None:
    def gone(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                fs, at = common.filesystem(p)
                fs.delete_file(at)
            yield batch.slice(0, 0)

    paths.mapInArrow(gone, "path string").count()


def decode_file(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, tokens of each, all their ids) of each group of a file."""
    fs, at = common.filesystem(path)
    with fs.open_input_stream(at) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        size, packed = struct.unpack("<II", f.read(8))
        lengths = np.frombuffer(zlib.decompress(f.read(packed)), np.uint8)
        assert len(lengths) == size
        decoder = decode_table(lengths)
        for names, sizes, tokens, blocks, bits in _read_groups(f):
            yield names, sizes, unpack(tokens, np.frombuffer(blocks, "<u2"), bits, decoder)


def digests(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["base"]
                for names, sizes, ids in decode_file(row["path"]):
                    ends = np.cumsum(sizes.astype(np.int64))
                    starts = ends - sizes.astype(np.int64)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.record_batch({"doc_id": pa.array(names, pa.int64()), "start": pa.array(starts + at), "n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})
                    at += int(ends[-1])

    return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
