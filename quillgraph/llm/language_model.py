"""Interpolated modified Kneser-Ney model of any order in sorted, memory-mapped hash arrays.

A sequence of m words, a gram, is told by the hashes of its first and of its last m - 1 words, its
prefix and its suffix; the hash of both is its own.

Counting. Each task of a scan hashes its words by array operations, merges equal words and equal
grams, and sends them, packed, to shards. A gram's shard takes half of its bits from the prefix and
half from the suffix, so a word that is everywhere spreads over many shards. From the longest grams
down, a shard merges its grams into one file of sorted hashes and counts, and passes on how many
followers each prefix has (seen once, twice, more often) and how many predecessors each suffix has.
These are the counts of the grams one word shorter; a gram at a text's start, with no predecessor,
keeps its own count. Shards are as many as the text needs, but a task splits its counts into at most
4^``FAN_BITS`` blobs; where the shards are more, further shuffles split these again.

Scoring. Workers map the files into memory and look up the sorted different words and grams of a
few megabytes of text at a time. Files in a folder that is a local path for every worker are
mapped in place; those of a remote store are fetched into anonymous maps, up to ``FETCHED_BYTES``.
Which files there are is read from index files, one for ``INDEXED`` shards.

The probability of a word w behind h, with counts c and discounts D by count (1, 2, 3 and more):
    p(w|h) = (c(hw) - D(c(hw))) / c(h) + g(h) p(w|h'),  g(h) = sum of D over h's followers / c(h)
    p(w)   = (n(w) - E(n(w))) / n + g / (V + 1),     n(w): different words before w, n: their sum
h' is h without its first word, c(h) the sum of its followers' counts; p(w|h') alone if h was never
seen. A text starts behind a start mark and closes with an end token.

Words are told apart by 64 bits, prefixes and suffixes by 48 bits each.

Defined cases: a null or empty text is the end token alone; a null ``doc_id`` is in the training
part; repeated rows count and score each; other columns are ignored; an empty training part gives
uniform scores; an empty table gives no rows.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashes of the end token and of the start mark; no word has them but by chance.
END, START = 0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F
#: Tokens whose grams a counting task merges at once, and text bytes a shard.
MERGE_TOKENS = 2_500_000
SHARD_BYTES = 32 << 20
#: A task splits its counts by twice as many bits at most; shards of an index file.
FAN_BITS = 6
INDEXED = 4096
_BLOB = "shard int, depth int, kind int, size int, n long, a binary, b binary, c binary, d binary, e binary"
_BLOB_SCHEMA = pa.schema([("shard", pa.int32()), ("depth", pa.int32()), ("kind", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), *[(x, pa.binary()) for x in "abcde"]])
_GRAM, _FIRST, _SECOND, _FILE, _COUNTS = range(5)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether a document is in the held-out part, by the crc32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _keys(x: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of hashes, lowest first, in planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unkeys(b: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - width :] = planes.T
    return out.view("<u8").reshape(-1)


def _ints(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, and compressed."""
    import zstandard

    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unints(b: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), b[:1].decode()).astype(np.int64)


def _narrow(h: np.ndarray) -> np.ndarray:
    """A hash as a prefix or suffix: its upper 48 bits."""
    return h & np.uint64(0xFFFFFFFFFFFF0000)


def gram_key(prefix: np.ndarray, suffix: np.ndarray, bits: int) -> np.ndarray:
    """Hash of grams of narrowed prefixes and suffixes; its upper 2 * ``bits`` bits are the shard."""
    from .bytescan import mix

    k = mix(prefix * np.uint64(0x9FB21C651E98DF25) + suffix)
    shard = ((prefix >> np.uint64(64 - bits)) << np.uint64(bits)) | (suffix >> np.uint64(64 - bits))
    return (shard << np.uint64(64 - 2 * bits)) | (k >> np.uint64(2 * bits))


def _runs(x: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _sum(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    return (keys[first], *[np.add.reduceat(c[order].astype(np.int64), first) for c in counts])


def _merged(kind: int, size: int, parts: list[tuple], bits: int) -> tuple[np.ndarray, tuple]:
    """(different keys in order, the arrays of ``_pack`` with equal keys summed)."""
    arrays = [np.concatenate(x) for x in zip(*parts)]
    if kind != _GRAM or size == 1:
        out = _sum(*arrays)
        return out[0], out
    v, w, c = arrays
    key = gram_key(v, w, bits)
    order = np.argsort(key)
    key = key[order]
    first = _runs(key)
    count = np.add.reduceat(c[order], first) if len(key) else c
    return key[first], (v[order[first]], w[order[first]], count)


def _pack(kind: int, size: int, arrays: tuple) -> list[bytes]:
    """Columns a to e of words (key, count), longer grams (prefix, suffix, count) or numbers of a key."""
    if kind == _GRAM and size > 1:
        v, w, c = arrays
        order = np.argsort(v)
        v = v[order]
        run = _runs(v)
        out = [_keys(v[run], 6), _ints(np.diff(np.append(run, len(v)))), _keys(w[order], 6), _ints(c[order])]
    else:
        out = [_keys(arrays[0], 8 if kind == _GRAM else 6), *map(_ints, arrays[1:])]
    return out + [b""] * (5 - len(out))


def _unpack(row: dict) -> tuple:
    if row["kind"] == _GRAM and row["size"] > 1:
        return np.repeat(_unkeys(row["a"], 6), _unints(row["b"])), _unkeys(row["c"], 6), _unints(row["d"])
    return _unkeys(row["a"], 8 if row["kind"] == _GRAM else 6), *[_unints(row[x]) for x in "bcde" if row[x]]


def _blobs(kind: int, size: int, key: np.ndarray, arrays: tuple, depth: int) -> Iterator[tuple]:
    """Rows of the shards of ``depth`` that the sorted keys fall into."""
    shard = (key >> np.uint64(64 - 2 * depth)).astype(np.int64)
    cuts = _runs(shard)
    for a, b in zip(cuts, np.append(cuts[1:], len(key))):
        yield int(shard[a]), depth, kind, size, int(b - a), *_pack(kind, size, tuple(x[a:b] for x in arrays))


def _batches(rows: Iterator[tuple], most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _rows(held)
            held = []
    if held:
        yield _rows(held)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_BLOB_SCHEMA), _BLOB_SCHEMA)], schema=_BLOB_SCHEMA)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end token a row, the token before each, tokens of each row, first of each row)."""
    from .bytescan import words

    h, n = words(column)
    counts = n + 1
    ends = np.cumsum(counts) - 1
    out = np.empty(len(h) + len(n), np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = h, np.uint64(END)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    firsts = ends - n
    before[firsts] = np.uint64(START)
    return out, before, counts, firsts


def _grams(w: np.ndarray, v: np.ndarray, at: np.ndarray, order: int, bits: int) -> Iterator[tuple]:
    """(size, places, prefixes, suffixes) of the grams that end at tokens ``w`` behind ``v``, the ``at``-th of their texts."""
    prefix, suffix, places = _narrow(v), _narrow(w), np.arange(len(w))
    yield 2, places, prefix, suffix
    for size in range(3, order + 1):
        key = np.zeros(len(w), np.uint64)
        key[places] = _narrow(gram_key(prefix, suffix, bits))
        places = np.flatnonzero(at >= size - 2)
        prefix, suffix = key[places - 1], key[places]
        yield size, places, prefix, suffix


def _count(bits: int, depth: int, order: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in common.pieces(batch, "text", 4 << 20):
                w, v, counts, firsts = tokens(part.column("text"))
                held.append((w, v, np.arange(len(w)) - np.repeat(firsts, counts)))
                size += len(w)
                if size >= MERGE_TOKENS:
                    yield from _batches(merged(held), 64)
                    held, size = [], 0
        if held:
            yield from _batches(merged(held), 64)

    def merged(held) -> Iterator[tuple]:
        w, v, at = (np.concatenate(x) for x in zip(*held))
        held.clear()
        docs = int((at == 0).sum())
        key, arrays = _merged(_GRAM, 1, [(w, np.ones(len(w), np.int64)), (np.array([START], np.uint64), np.array([docs]))], bits)
        yield from _blobs(_GRAM, 1, key, arrays, depth)
        for size, _, prefix, suffix in _grams(w, v, at, order, bits):
            key, arrays = _merged(_GRAM, size, [(prefix, suffix, np.ones(len(prefix), np.int64))], bits)
            yield from _blobs(_GRAM, size, key, arrays, depth)

    return scan


def _resplit(bits: int, depth: int):
    """Blobs of fewer, larger shards to those of shards of ``depth``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault((row["kind"], row["size"]), []).append(_unpack(row))
                entries += row["n"]
                if entries >= MERGE_TOKENS:
                    yield from _batches(split(held))
                    held, entries = {}, 0
        yield from _batches(split(held))

    def split(held: dict) -> Iterator[tuple]:
        for (kind, size), parts in held.items():
            yield from _blobs(kind, size, *_merged(kind, size, parts, bits), depth)

    return scan


def _to_shards(blobs: DataFrame, bits: int, fan: int, text_bytes: int) -> DataFrame:
    """``blobs`` of all depths as blobs of single shards."""
    depth = min(bits, fan)
    while depth < bits:
        groups, partitions = 1 << (2 * depth), max(8, text_bytes // (128 << 20))
        # a large group is dealt to several tasks, by the task it comes from so that a second try deals alike
        slices = F.pmod(F.spark_partition_id(), F.lit(max(1, -(-partitions // groups))))
        after = min(bits, depth + fan)
        coarse = blobs.where(F.col("depth") == depth).withColumn("slice", slices).repartition(int(partitions), "shard", "slice").drop("slice")
        blobs = blobs.where(F.col("depth") != depth).union(coarse.mapInArrow(_resplit(bits, after), _BLOB))
        depth = after
    return blobs


def _save(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Arrays one after the other in a new file under ``folder``; returns its path."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(common.filesystem(path)[1], compression=None) as f:
        for x in arrays:
            f.write(np.ascontiguousarray(x).data)
    return path


def _clipped(x: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """(large ones, arrays): the places and values of those above 254, and all as bytes."""
    big = np.flatnonzero(x >= 255)
    return len(big), [big.astype("<u8"), x[big].astype("<u8"), np.minimum(x, 255).astype(np.uint8)]


def _of_shard(table: pa.Table) -> dict[tuple[int, int], list[tuple]]:
    """Arrays by kind and size."""
    out = {}
    for row in table.to_pylist():
        out.setdefault((row["kind"], row["size"]), []).append(_unpack(row))
    return out


def _numbers(parts: list[tuple] | None, of: np.ndarray, width: int) -> list[np.ndarray]:
    """The summed numbers of the keys ``of``, zeros for those without."""
    if not parts:
        return [np.zeros(len(of), np.int64)] * width
    k, *sums = _sum(*[np.concatenate(x) for x in zip(*parts)])
    at, there = _find(k, of)
    return [np.where(there, x[at], 0) for x in sums]


def _counts_of(x: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(x, 5), minlength=6)[1:5]


def _merge_grams(folder: str, bits: int, depth: int, order: int, size: int):
    """The step of a shard for its grams of ``size`` words; shorter ones are merged and passed on."""

    def rows(held: dict, shard: int) -> Iterator[tuple]:
        for short in range(1, size):
            if parts := held.get((_GRAM, short)):
                yield from _blobs(_GRAM, short, *_merged(_GRAM, short, parts, bits), bits)
        if (_GRAM, size) not in held:
            return
        key, (v, w, count) = _merged(_GRAM, size, held.pop((_GRAM, size)), bits)
        context = []
        if size < order:
            raw, narrow = count, _narrow(key)
            # how often each gram is followed, in all: its own count, if the longer grams have theirs
            context = _numbers(held.get((_FIRST, size)), narrow, 3 if size == order - 1 else 4)
            context = [*context[:3], raw if size == order - 1 else context[3]]
            before, = _numbers(held.get((_SECOND, size)), narrow, 1)
            count = np.where(before > 0, before, raw)
        bigs, arrays = zip(*map(_clipped, [count, *context]))
        path = _save(folder, f"grams-{size}-{shard:05d}", key, *[x for three in arrays for x in three])
        yield shard, bits, _FILE, size, len(key), json.dumps([path, len(key), *bigs]).encode(), b"", b"", b"", b""
        yield shard, bits, _COUNTS, size, 0, _counts_of(count).astype("<u8").tobytes(), b"", b"", b"", b""
        total = [count] if size < order else []
        first = _sum(v, count == 1, count == 2, count >= 3, *total)
        yield from _blobs(_FIRST, size - 1, first[0], first, depth)
        second = _sum(w, np.ones(len(w), np.int64))
        yield from _blobs(_SECOND, size - 1, second[0], second, depth)

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(list(rows(_of_shard(table), table.column("shard")[0].as_py())))])

    return merge


def _merge_words(folder: str, bits: int, order: int):
    def merge(table: pa.Table) -> pa.Table:
        shard, held = table.column("shard")[0].as_py(), _of_shard(table)
        key, (_, count) = _merged(_GRAM, 1, held[_GRAM, 1], bits)
        narrow = _narrow(key)
        one, two, more, *total = _numbers(held.get((_FIRST, 1)), narrow, 3 if order == 2 else 4)
        before, = _numbers(held.get((_SECOND, 1)), narrow, 1)
        bigs, arrays = zip(*map(_clipped, [count, one, two, more, *(total or [count]), before]))
        path = _save(folder, f"words-{shard:05d}", key, *[x for three in arrays for x in three])
        # tokens of the training part: the start mark is none, the end token is one
        real = key != np.uint64(START)
        totals = np.array([*_counts_of(before), (before >= 3).sum(), before.sum(), count[real].sum(), real.sum()], "<u8")
        blank = [b""] * 4
        return pa.Table.from_batches([_rows([(shard, bits, _FILE, 1, len(key), json.dumps([path, len(key), *bigs]).encode(), *blank), (shard, bits, _COUNTS, 1, 0, totals.tobytes(), *blank)])])

    return merge


def _index(folder: str, name: str):
    """The index file of a range of shards, and the sum of their numbers."""

    def write(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part = rows[0]["shard"] // INDEXED
        files = {r["shard"]: json.loads(r["a"]) for r in rows if r["kind"] == _FILE}
        fs, path = common.filesystem(f"{folder}/{name}-{part}")
        with fs.open_output_stream(path, compression=None) as f:
            f.write(json.dumps(files).encode())
        sums = sum(np.frombuffer(r["a"], "<u8").astype(np.int64) for r in rows if r["kind"] == _COUNTS)
        return pa.table({"numbers": pa.array([sums.tolist()], pa.list_(pa.int64())), "part": pa.array([part], pa.int32())})

    return write


def discounts(of: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 and more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in of)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else 0.5 * k
        out.append(min(max(d, 0.05 * k), 0.95 * k))
    return np.array(out)


@dataclass
class Model:
    """Totals of a model and where its files are; small, and shipped to the workers with each task."""

    folder: str
    name: str
    bits: int
    order: int
    parts: dict[int, frozenset[int]]  # index files by size of gram
    discounts: dict[int, np.ndarray]
    n_before: float
    back_off: float
    tokens: int
    vocabulary: int


def fit(docs: DataFrame, folder: str, order: int = 2, shard_bytes: int = SHARD_BYTES, fan: int = FAN_BITS) -> Model:
    """The model of all rows of ``docs`` (text), in files under ``folder``. ``order``: words of the longest grams, 2 at least."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1
    while (shard_bytes << (2 * bits)) < size:
        bits += 1
    # one shuffle of the counts; those of shorter grams pass through the shards of the longer ones
    blobs = text.mapInArrow(_count(bits, min(bits, fan), order), _BLOB)
    name, parts, numbers = uuid.uuid4().hex, {}, {}
    for m in range(order, 0, -1):
        merge = _merge_grams(folder, bits, min(bits, fan), order, m) if m > 1 else _merge_words(folder, bits, order)
        merged = common.cut(spark, _to_shards(blobs, bits, fan, size).groupBy("shard").applyInArrow(merge, _BLOB))
        done = merged.where(F.col("kind").isin(_FILE, _COUNTS)).groupBy(F.floor(F.col("shard") / INDEXED).alias("part"))
        # a row for each index file
        rows = done.applyInArrow(_index(folder, f"index-{name}-{m}"), "numbers array<bigint>, part int").collect()
        parts[m] = frozenset(r["part"] for r in rows)
        numbers[m] = np.sum([r["numbers"] for r in rows], axis=0) if rows else np.zeros(8, np.int64)
        blobs = merged.where(~F.col("kind").isin(_FILE, _COUNTS))
    found = {m: discounts(x[:4]) for m, x in numbers.items()}
    totals, lower = numbers[1], found[1]
    n_before = max(float(totals[5]), 1.0)
    back_off = float(lower[1] * totals[0] + lower[2] * totals[1] + lower[3] * totals[4]) / n_before if totals[5] else 1.0
    return Model(folder, name, bits, order, parts, found, n_before, back_off, int(totals[6]), int(totals[7]))


#: Bytes of files of a remote store that a worker holds.
FETCHED_BYTES = 1 << 30
_maps: dict[str, np.ndarray] = {}
_fetched: dict[str, int] = {}


def _mapped(path: str) -> np.ndarray:
    """The bytes of a file, mapped into memory; those of a remote store are fetched into anonymous maps, the oldest of which go first."""
    if path not in _maps:
        while len(_maps) > 4096:
            old = next(iter(_maps))
            _maps.pop(old)
            _fetched.pop(old, None)
        fs, at = common.filesystem(path)
        if fs.type_name == "local":
            with open(at, "rb") as f:
                _maps[path] = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        else:
            size = fs.get_file_info(at).size
            while _fetched and sum(_fetched.values()) + size > FETCHED_BYTES:
                old = next(iter(_fetched))
                _fetched.pop(old)
                _maps.pop(old, None)
            held = mmap.mmap(-1, max(size, 1))
            with fs.open_input_stream(at, compression=None) as f:
                while part := f.read(4 << 20):
                    held.write(part)
            _maps[path], _fetched[path] = np.frombuffer(held, np.uint8)[:size], size
    return _maps[path]


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each asked key among the sorted keys, whether it is there)."""
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at, keys[at] == asked


_indexes: dict[str, dict[int, list]] = {}


def _by_count(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, 3).astype(np.int64)]


class Reader:
    """Look-ups in a model's files."""

    def __init__(self, model: Model):
        self.model = model

    def _files(self, asked: np.ndarray, size: int) -> Iterator[tuple[int, int, list]]:
        """(first, end, file) of the shards of sorted keys."""
        shard = (asked >> np.uint64(64 - 2 * self.model.bits)).astype(np.int64)
        cuts = _runs(shard)
        for a, b in zip(cuts, np.append(cuts[1:], len(asked))):
            file = self._index(size, int(shard[a]) // INDEXED).get(int(shard[a]))
            if file:
                yield a, b, file

    def _index(self, size: int, part: int) -> dict[int, list]:
        m = self.model
        if part not in m.parts[size]:
            return {}
        path = f"{m.folder}/index-{m.name}-{size}-{part}"
        if path not in _indexes:
            while len(_indexes) > 64:
                _indexes.pop(next(iter(_indexes)))
            fs, at = common.filesystem(path)
            with fs.open_input_stream(at, compression=None) as f:
                _indexes[path] = {int(k): x for k, x in json.loads(f.read()).items()}
        return _indexes[path]

    def grams(self, asked: np.ndarray, size: int) -> np.ndarray:
        """Numbers of sorted keys, a column each.

        Rows: count and, below the model's order, followers seen once, twice, more, count as a
        context; of words predecessors too.
        """
        out = np.zeros((6 if size == 1 else 5 if size < self.model.order else 1, len(asked)))
        for a, b, (path, n, *bigs) in self._files(asked, size):
            raw = _mapped(path)
            at, there = _find(raw[: 8 * n].view("<u8"), asked[a:b])
            base = 8 * n
            for k, big in enumerate(bigs):
                places, values = (raw[base + 8 * i * big : base + 8 * (i + 1) * big] for i in (0, 1))
                got = raw[base + 16 * big : base + 16 * big + n][at].astype(np.float64)
                large = np.flatnonzero(there & (got == 255))
                if len(large):
                    # copies: what stands before them may leave them unaligned
                    i, _ = _find(np.frombuffer(places.tobytes(), "<u8"), at[large].astype(np.uint64))
                    got[large] = np.frombuffer(values.tobytes(), "<u8")[i]
                out[k, a:b] = np.where(there, got, 0)
                base += 16 * big + n
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, log10 probability) of each row."""
        m = self.model
        w, v, counts, firsts = tokens(column)
        unique, place = np.unique(np.concatenate([w, [np.uint64(START)]]), return_inverse=True)
        stats = self.grams(unique, 1)
        count, before = stats[0], stats[5]
        p_word = np.maximum(before - _by_count(m.discounts[1], before), 0) / m.n_before + m.back_off / (m.vocabulary + 1)
        w_at = place[:-1]
        v_at = np.empty_like(w_at)
        v_at[1:] = w_at[:-1]
        v_at[firsts] = place[-1]
        p = p_word[w_at]
        total, left = (x[v_at] for x in self._context(stats, 2))
        for size, places, prefix, suffix in _grams(w, v, np.arange(len(w)) - np.repeat(firsts, counts), m.order, m.bits):
            keys, key_at = np.unique(gram_key(prefix, suffix, m.bits), return_inverse=True)
            found = self.grams(keys, size)
            own = np.maximum(found[0] - _by_count(m.discounts[size], found[0]), 0)[key_at]
            if size > 2:  # a gram is the context of the token behind it
                total, left = total[places], left[places]
            p[places] = own / total + left * p[places]
            if size < m.order:
                total, left = np.ones(len(w) + 1), np.ones(len(w) + 1)
                total[places + 1], left[places + 1] = (x[key_at] for x in self._context(found, size + 1))
        c = count[w_at]
        base = np.log10((c + 1) / (m.tokens + m.vocabulary + 1))
        text = lambda x: np.add.reduceat(x, firsts) if len(x) else x
        return counts, text((c > 0).astype(np.int64)), text(base), text(np.log10(p))

    def _context(self, found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, 1 at least, and what is left for shorter grams) behind the contexts of grams of ``size``."""
        total, d = np.maximum(found[4], 1), self.model.discounts[size]
        return total, np.where(found[4] > 0, (found[1] * d[1] + found[2] * d[2] + found[3] * d[3]) / total, 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part in common.pieces(batch, "text", 4 << 20):
                n, known, base, own = reader.score(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(n), model.tokens), pa.int64()), "base_score": base, "score": own})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.freed(scan), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """``scored`` with the perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
