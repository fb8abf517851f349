"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces of the product of their probabilities, found by
the forward algorithm; a text's is the product over its words. Piece probabilities are fitted by
expectation maximisation with the forward-backward algorithm.

Words are runs of letters (Unicode's category L) of any length, in lower case, behind a word mark.
Letters that are no piece stand for one unknown piece. The words of a batch that a worker has not
met are scored together by array operations; their scores are kept for the following batches, up
to ``KEPT_BYTES``.

The piece probabilities are fitted on a bounded sample: ``SAMPLE`` documents of each language, those
of least id hash among the training part. The prior of a language counts its whole training part.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without training
documents all are; repeated rows are predicted alike; a null ``doc_id`` is not held out and not in
the sample; a null ``lang`` teaches nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 500
ROUNDS = 3
KEPT_BYTES = 64 << 20
SMOOTHING = 0.05
#: Letters between two scalings of the forward sums, against underflow.
_SCALED = 8
_RUNS = re.compile(r"[^\W\d_]+")
_PRIME = 0x9E3779B97F4A7C15


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def text_words(text: str) -> list[str]:
    """Runs of letters; ``[^\\W\\d_]`` has other numerals beside them, such as ``²`` and ``Ⅷ``."""
    out = _RUNS.findall(text.lower())
    if all(map(str.isalpha, out)):
        return out
    return [w for x in out for w in ("".join(c if c.isalpha() else " " for c in x).split() if not x.isalpha() else [x])]


def _string_hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * _PRIME + ord(c) + 1) % (1 << 64)
    return h


class Vocabulary:
    """The pieces, found by hash; piece 0 stands for unknown letters."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = sorted(p for p in pieces if p.lstrip("▁") == p or p.lstrip("▁").isalpha() or p == "▁")
        self.longest = max(map(len, self.pieces))
        self.size = len(self.pieces) + 1
        # every prefix of a piece, with the piece's number if it is one itself
        prefixes: dict[str, int] = {}
        for i, p in enumerate(self.pieces, 1):
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], 0)
            prefixes[p] = i
        h = np.array([_string_hash(p) for p in prefixes], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array(list(prefixes.values()), np.int64)[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is of a prefix, its piece or 0)."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        there = self.hashes[at] == h
        return there, np.where(there, self.ids[at], 0)


_vocabularies: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class _Lattice:
    """Words of one length, and the pieces that begin at each of their places."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        self.vocab, self.many, self.length = vocab, len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(self.many, self.length)
        self.codes = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)

    def pieces(self, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, words that have a piece from ``start`` to there, the pieces)."""
        alive, running = np.arange(self.many), np.zeros(self.many, np.uint64)
        for end in range(start + 1, min(start + self.vocab.longest, self.length) + 1):
            running = running * np.uint64(_PRIME) + self.codes[end - 1][alive]
            there, piece = self.vocab.find(running)
            # a single letter always stands, as the unknown piece if need be
            yield (end, alive, piece) if end == start + 1 else (end, alive[piece > 0], piece[piece > 0])
            alive, running = alive[there], running[there]
            if not len(alive):
                return


def _lattices(words: list[str], vocab: Vocabulary) -> Iterator[tuple[np.ndarray, _Lattice]]:
    """(places of the words, their lattice) of each length."""
    marked = ["▁" + w for w in words]
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(marked):
        by_length.setdefault(len(w), []).append(i)
    for at in by_length.values():
        yield np.array(at), _Lattice([marked[i] for i in at], vocab)


def word_scores(words: list[str], vocab: Vocabulary, probabilities: np.ndarray) -> np.ndarray:
    """log P(word) for each word and language; ``probabilities``: pieces x languages."""
    out = np.zeros((len(words), probabilities.shape[1]))
    for at, lattice in _lattices(words, vocab):
        n, ring = lattice.length, vocab.longest + 1
        # sums up to a place lie in a ring: none is needed beyond the longest piece
        alpha, scale = np.zeros((ring, len(at), probabilities.shape[1])), np.zeros((len(at), probabilities.shape[1]))
        alpha[0] = 1.0
        for start in range(n):
            now = alpha[start % ring]
            if start and start % _SCALED == 0:
                scale += np.log(now)
                alpha /= now.copy()
                now = alpha[start % ring]
            for end, has, piece in lattice.pieces(start):
                alpha[end % ring][has] += now[has] * probabilities[piece]
            now[:] = 0.0
        out[at] = np.log(alpha[n % ring]) + scale
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocab: Vocabulary, probabilities: np.ndarray) -> np.ndarray:
    """Expected number of each piece in ``counts`` (one a word) copies of the words of one language."""
    out = np.zeros(vocab.size)
    for at, lattice in _lattices(words, vocab):
        n = lattice.length
        alpha, beta, scale = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at))), np.ones((n + 1, len(at)))
        alpha[0], beta[n] = 1.0, 1.0
        for start in range(n):
            if start and start % _SCALED == 0:
                scale[start] = alpha[start]  # divides the sums from here on
                alpha[start : start + vocab.longest] /= scale[start]
            for end, has, piece in lattice.pieces(start):
                alpha[end][has] += alpha[start][has] * probabilities[piece]
        share = counts[at] / alpha[n]
        for start in range(n - 1, -1, -1):
            for end, has, piece in lattice.pieces(start):
                # what lies between two scalings is divided once more, as the sums up to its end are
                next_scaled = (start // _SCALED + 1) * _SCALED
                p = probabilities[piece] * beta[end][has]
                for k in range(next_scaled, min(end, n - 1) + 1, _SCALED):
                    p = p / scale[k][has]
                beta[start][has] += p
                out += np.bincount(piece, alpha[start][has] * p * share[has], minlength=vocab.size)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, pieces: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, piece probabilities, log priors) from labelled documents (doc_id, text, lang)."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    labelled = docs.where("lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    prior = sorted(labelled.groupBy("lang").count().collect())  # one row a language
    if not prior:
        return [], np.zeros((0, 0)), np.zeros(0)
    langs = [x[0] for x in prior]
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the limit is applied before the shuffle too, so a task hands on at most ``sample`` ids a language
    chosen = labelled.where("doc_id is not null").select("doc_id", "lang").withColumn("r", F.row_number().over(by)).where(F.col("r") <= sample).select("doc_id", "lang")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            got = Counter((lang, w) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if text for w in text_words(text))
            yield pa.record_batch([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])

    # at most ``sample`` ids of eight bytes a language are broadcast
    texts = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counted = texts.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = common.cut(spark, counted)
    vocab = vocabulary(pieces)
    p = np.full((vocab.size, len(langs)), 1.0 / vocab.size)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            vocab, total = vocabulary(pieces), np.zeros((len(langs), len(p)))
            for batch in batches:
                got = batch.to_pydict()
                lang, n = np.array(got["lang"]), np.array(got["n"], float)
                for k, name in enumerate(langs):
                    mine = np.flatnonzero(lang == name)
                    if len(mine):
                        total[k] += expected_counts([got["word"][i] for i in mine], n[mine], vocab, p[:, k])
            k, piece = np.nonzero(total)
            yield pa.record_batch({"k": pa.array(k, pa.int64()), "piece": pa.array(piece, pa.int64()), "n": pa.array(total[k, piece])})

        counts = np.full(p.shape, SMOOTHING)
        for k, piece, n in counted.mapInArrow(expect, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n")).collect():  # a number a piece and language
            counts[piece, k] += n
        p = counts / counts.sum(axis=0)
    total = sum(x[1] for x in prior)
    return langs, p, np.log([x[1] / total for x in prior])


class Scorer:
    def __init__(self, langs: list[str], p: np.ndarray, prior: np.ndarray, pieces: str | None):
        self.langs, self.p, self.prior, self.vocab = langs, p, prior, vocabulary(pieces)
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.known = np.zeros((1024, len(langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cut = [text_words(x) if x else [] for x in texts]
        place = self.place
        new = {w for words in cut for w in words if w not in place}
        self.bytes += sum(map(len, new)) + (200 + 8 * len(self.langs)) * len(new)
        if self.bytes > KEPT_BYTES:  # start over with the words at hand
            place.clear()
            new = {w for words in cut for w in words}
            self.bytes = sum(map(len, new)) + (200 + 8 * len(self.langs)) * len(new)
        if new:
            names, base = list(new), len(place)
            if base + len(names) > len(self.known):
                more = np.zeros((max(2 * len(self.known), base + len(names)), len(self.langs)))
                more[: len(self.known)] = self.known
                self.known = more
            self.known[base : base + len(names)] = word_scores(names, self.vocab, self.p)
            place.update(zip(names, range(base, base + len(names))))
        langs, scores = [], np.zeros(len(texts))
        for i, words in enumerate(cut):
            if not words:
                langs.append("und")
                continue
            total = self.known[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0) + self.prior
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores[i] = 1.0 / np.exp(total - total[best]).sum()
        return langs, scores


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, prior: np.ndarray, pieces: str | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row; only ``text`` decides."""

    model = docs.sparkSession.sparkContext.broadcast((langs, p, prior))  # a number a piece and language

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value, pieces) if langs else None
        for batch in batches:
            for part in common.pieces(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                names, scores = scorer.predict(texts) if scorer else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": scores})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")
