"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Pieces are dealt out to groups by a hash. Each group is packed by best fit decreasing, and lower
bounds from dual-feasible functions certify its number of bins. Groups above their bound release
the documents of their unfilled bins, and every group releases its emptiest bin, which holds the
remainder that a whole number of bins rounds up. Released pieces are dealt out anew, to fewer
groups, and packed again; the exchange is kept if it needs fewer bins. This repeats until nothing
is gained.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are pieces
of their own; a null ``doc_id`` is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Pieces of a group, on average: all that a task holds.
GROUP_PIECES = 20_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "uid long, " + _PIECE + ", grp long, bin long, offset long, room long, bound long, bins long"


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY, tokenizers: str | None = None) -> DataFrame:
    """A row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, tail = encoder(tokenizer, tokenizers), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in common.pieces(batch, "text"):
                out = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.ids(part.column("text").to_pylist())):
                    raw = ids + tail
                    out += [(doc, k, a // 4, len(raw[a : a + 4 * capacity]) // 4, zlib.crc32(raw[a : a + 4 * capacity])) for k, a in enumerate(range(0, len(raw), 4 * capacity))]
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.record_batch([pa.array(x, pa.int32() if n == "piece" else pa.int64()) for n, x in zip(names, zip(*out))], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.freed(scan), _PIECE)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: the fullest bin that still takes it, larger pieces first."""
    out = np.zeros(len(sizes), np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, made = 0, 0  # bit r of rooms: a bin with room r
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = bins[room].pop()
            if not bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        out[at] = b
        bins[room - size].append(b)
        rooms |= 1 << (room - size)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions.

    For a threshold t: pieces over capacity - t count as whole bins, pieces under t as nothing.
    For k: a piece x counts as x if (k+1)x/capacity is whole, else as floor((k+1)x/capacity)/k of a bin.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1, dtype=np.int64)
    many, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * s)])
    t = np.arange(0, capacity // 2 + 1)
    whole = many[-1] - many[capacity - t + 1]
    best = int((whole + -(-(mass[capacity - t + 1] - mass[t]) // capacity)).max())
    for k in range(1, 41):
        part, rest = np.divmod((k + 1) * s, capacity)
        scaled = np.where(rest == 0, k * s, part * capacity)  # of k * capacity
        best = max(best, int(-(-int((n * scaled).sum()) // (k * capacity))))
    return best


def _pack_group(capacity: int):
    def packed(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        uid = table.column("uid").to_numpy()
        by = np.argsort(uid, kind="stable")  # the same packing for the same pieces, in whatever order they come
        bins = np.empty(len(sizes), np.int64)
        bins[by] = best_fit_decreasing(sizes[by], capacity)
        order = np.lexsort((uid, bins))
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        base = np.repeat(ends[first] - sizes[order][first], np.diff(np.append(first, len(order))))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - base
        room = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
        more = {"bin": bins, "offset": offset, "room": room[bins], "bound": np.full(len(sizes), lower_bound(sizes, capacity)), "bins": np.full(len(sizes), len(room))}
        for name, x in more.items():
            table = table.append_column(name, pa.array(x, pa.int64()))
        return table.select(["uid", "doc_id", "piece", "start", "length", "ids_crc32", "grp", *more])

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset``, and ``bins`` and ``bound`` of the group packed last."""
    spark = pieces.sparkSession
    left = common.cut(spark, pieces.withColumn("uid", F.monotonically_increasing_id()))
    done = None
    released = None  # bins given up for this round
    for turn in count():
        many = left.count()
        groups = max(1, round(many / GROUP_PIECES))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        packed = common.cut(spark, dealt.groupBy("grp").applyInArrow(_pack_group(capacity), _PLACED))
        if released is not None:
            made = packed.agg(F.count_distinct("grp", "bin")).first()[0]
            if made >= released[1]:
                break
            done = kept.union(_named(packed, turn)) if kept is not None else _named(packed, turn)
        else:
            done = _named(packed, turn)
        if groups == 1 and turn:
            break
        # the emptiest bin of each group; and, above the bound, all bins with room
        least = packed.groupBy("grp").agg(F.max_by("bin", F.struct("room", "bin")).alias("least"))
        marked = packed.join(least, "grp").withColumn("free", (F.col("room") > 0) & ((F.col("bin") == F.col("least")) | (F.col("bins") > F.col("bound"))))
        marked = common.cut(spark, marked)
        free = marked.where("free")
        n_free = free.agg(F.count_distinct("grp", "bin")).first()[0]
        if n_free < 2 or groups == 1 and not turn:
            break
        stay = _named(marked.where("not free"), turn)
        kept = stay if turn == 0 else kept.union(stay)
        released = (turn, n_free)
        left = common.cut(spark, free.select("uid", "doc_id", "piece", "start", "length", "ids_crc32"))
    return done


def _named(packed: DataFrame, turn: int) -> DataFrame:
    # the rounds end, as each needs fewer bins than the one before; 2^11 of them, 2^31 groups and 2^20 bins have numbers
    sequence = F.lit(turn).cast("long") * (1 << 51) + F.col("grp") * (1 << 20) + F.col("bin")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", "bins", "bound")
