"""Secret scanning with a random forest that removes false positives.

A scan proposes candidates: values assigned to a name such as ``token`` or ``password``, strings of
known formats, private-key blocks, and long strings that mix letters and digits. A random forest
over each candidate's length, character transitions, dictionary coverage, path and neighbouring
words tells secrets from look-alikes: placeholders, identifiers, checksums, commits, paths, words.

The forest is fitted from labelled findings. ``labelled_findings`` makes the built-in ones, a
seeded sample of ``FINDINGS`` contexts of both labels built from public formats; labelled findings
of one's own can be passed instead. The fit is a bounded labelled sample; the scan covers all texts.

Defined cases: null and empty texts have no findings; repeated rows give repeated findings; a null
``doc_id`` is reported as null; a null path, or a table without one, is an empty path; other columns
are ignored by ``scan`` and kept by ``redact``; an empty table gives no findings.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, forest

FINDINGS = 6000
VERDICT = 0.5
REDACTED = "[SECRET]"
#: Fixed public formats.
FORMATS = (
    ("aws_key", re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")),
    ("github_token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("google_key", re.compile(r"AIza[0-9A-Za-z_\-]{35}")),
    ("slack_token", re.compile(r"xox[abprs]-[0-9A-Za-z\-]{10,}")),
    ("stripe_key", re.compile(r"[rs]k_live_[0-9A-Za-z]{16,}")),
    ("jwt", re.compile(r"eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}")),
)
_NAME = re.compile(r"token|secret|passw|pwd|api_?-?key|apikey|access_?-?key|auth|credential|private_?-?key", re.IGNORECASE)
#: A name that ends a text, read backwards: white space, a quote, letters of names.
_NAME_BACK = re.compile(r"\s*[\"']?([A-Za-z0-9_\-.]+)")
_VALUE = re.compile(r"[=:>]?\s*[\"'`]?([^\s\"'`,;]{6,})")
_SIGN = re.compile(r"[=:]")
_LONG = re.compile(r"(?<!\S)\S{16,}")
_STRING = re.compile(r"[A-Za-z0-9+/_\-]{20,}={0,2}")
_BLOCK_EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
_WORD = re.compile(r"[a-z]+")
_AROUND = 48
#: Neighbouring words that speak for a look-alike, and for a secret.
_HARMLESS = frozenset("example examples sample dummy placeholder test tests testing your changeme fake mock commit sha sha1 sha256 md5 hash checksum digest integrity etag uuid guid revision version id isbn href src url".split())
_TELLING = frozenset("token secret password passwd pwd key apikey api auth authorization bearer credential credentials private access".split())
_TEST_PATH = re.compile(r"test|example|fixture|sample|mock|docs?/|\.md|\.lock", re.IGNORECASE)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of candidates in ``text``, in order; overlapping ones become their union, under the most telling rule."""
    found = [(a, b, "private_key") for a, b in _blocks(text)] if "-----BEGIN" in text else []
    last = before = 0  # ends of the value and the sign met last
    for m in _SIGN.finditer(text):
        at, since, before = m.start(), before, m.end()
        if at + 2 < last:  # inside a value: its own would end where that does
            continue
        # a name holds no sign, so no character is read for two signs
        name = _NAME_BACK.match(text[since:at][::-1])
        if name and _NAME.search(name.group(1)[::-1]):
            value = _VALUE.match(text, at + 1)
            if value:
                last = value.end(1)
                found.append((*value.span(1), "assigned"))
    for m in _LONG.finditer(text):
        word = m.group()
        known = [(m.start() + x.start(), m.start() + x.end(), rule) for rule, form in FORMATS for x in form.finditer(word)]
        found += known
        if not known and any(c.isdigit() for c in word):
            for x in _STRING.finditer(word):
                s = x.group()
                if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.0:
                    found.append((m.start() + x.start(), m.start() + x.end(), "string"))
    out = []
    rank = {"string": 2, "assigned": 1}
    for a, b, rule in sorted(found, key=lambda x: (x[0], rank.get(x[2], 0), -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, rule))
        else:
            start, end, first = out[-1]
            out[-1] = (start, max(end, b), min(first, rule, key=lambda r: rank.get(r, 0)))
    return out


def _blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) from each first line of a private key to the next last line."""
    out, start = [], None
    for m in _BLOCK_EDGE.finditer(text):
        if m.group(1) == "BEGIN":
            start = m.start() if start is None else start
        elif start is not None:
            out.append((start, m.end()))
            start = None
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in map(s.count, set(s)))


class Features:
    """Features of candidates. The dictionary is a public tokenizer's pieces of four letters and more."""

    def __init__(self, pieces: str | None = None):
        from .language_id import vocabulary

        words = [p.lstrip("▁") for p in vocabulary(pieces).pieces]
        self.words = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())
        counts = np.full((28, 28), 0.5)
        for w in words:
            codes = self._codes(w)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.transitions = np.log2(counts / counts.sum(axis=1, keepdims=True))

    @staticmethod
    def _codes(s: str) -> np.ndarray:
        """a-z as 0 to 25, digits 26, all else 27."""
        b = np.frombuffer(s.lower().encode("latin-1", "replace"), np.uint8).astype(np.int64)
        return np.where((b >= 97) & (b <= 122), b - 97, np.where((b >= 48) & (b <= 57), 26, 27))

    def coverage(self, s: str) -> float:
        """Share of the characters that dictionary words cover, longest first from the left."""
        s, at, covered = s.lower(), 0, 0
        while at < len(s):
            n = next((n for n in range(min(14, len(s) - at), 3, -1) if s[at : at + n] in self.words), 0)
            covered, at = covered + n, at + max(n, 1)
        return covered / max(len(s), 1)

    def of(self, text: str, start: int, end: int, rule: str, path: str) -> list[float]:
        s = text[start:end]
        n = len(s)
        digits, upper, lower = sum(c.isdigit() for c in s), sum(c.isupper() for c in s), sum(c.islower() for c in s)
        kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
        codes = self._codes(s)
        before, after = text[max(0, start - _AROUND) : start].lower(), text[end : end + _AROUND].lower()
        near, last = _WORD.findall(before) + _WORD.findall(after), _WORD.findall(before)[-3:]
        inside = set(_WORD.findall(s.lower()))
        return [
            n,
            entropy(s),
            entropy(s) / math.log2(max(n, 2)),
            digits / n,
            upper / n,
            lower / n,
            (n - digits - upper - lower) / n,
            changes / max(n - 1, 1),
            float(self.transitions[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
            self.coverage(s),
            float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None),
            float(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", s) is not None),
            float(rule not in ("assigned", "string")),
            float(rule == "assigned"),
            s.count("/") + s.count("."),
            s.count("_") + s.count("-"),
            float(bool(re.search(r"[<>${}()\[\]*]", s))),
            max((len(m.group()) for m in re.finditer(r"(.)\1*", s, re.DOTALL)), default=0),
            float(bool(_TEST_PATH.search(path))),
            sum(w in _HARMLESS for w in near),
            sum(w in _TELLING for w in near),
            sum(w in _HARMLESS for w in last),
            sum(w in _TELLING for w in last),
            len(inside & _HARMLESS),
        ]


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, str, str, int]]:
    """(text, start, end, rule, path, label) of built-in findings: the candidates of made-up contexts."""
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllables = "an er on the ing st re en at ti be sch lich de la que ment ción ado tion ou th ha es".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 9)))
    names = ("token", "secret", "password", "api_key", "API_KEY", "auth_token", "client_secret", "access_key", "db_password", "private_key", "SECRET_KEY")
    secret = (
        lambda: some(hexa, rng.choice((32, 40, 40, 48, 64))),
        lambda: some(alnum, rng.randint(20, 48)),
        lambda: some(alnum + "+/", rng.choice((40, 44, 64))),
        lambda: "".join(rng.sample(word().capitalize() + some("0123456789", 3) + some("!#%+?@", 2), k=len(word()) % 2 + 6)) + some(alnum, 4),
        lambda: "AKIA" + some(alnum.upper(), 16),
        lambda: "ghp_" + some(alnum, 36),
        lambda: "sk_live_" + some(alnum, 24),
        lambda: "AIza" + some(alnum, 35),
        lambda: "eyJ" + some(alnum, 20) + ".eyJ" + some(alnum, 40) + "." + some(alnum, 43),
    )
    harmless = (
        lambda: rng.choice(("your_token_here", "YOUR-API-KEY", "changeme", "<your-secret>", "xxxxxxxxxxxxxxxx", "****************", "insert_token_here", "example-password", "placeholder", "REDACTED", "undefined", "required", "optional")),
        lambda: "${" + rng.choice(("TOKEN", "API_KEY", "DB_PASSWORD")) + "}",
        lambda: "os.environ['" + rng.choice(("TOKEN", "SECRET")) + "']",
        lambda: "get_" + "_".join(word() for _ in range(3)) + "()",
        lambda: word() + word(),
        lambda: ".".join(word() for _ in range(3)),
        lambda: "/".join(word() for _ in range(4)),
        lambda: some("0", 16) + some("01", 4),
    )
    strings = (
        ("commit ", lambda: some(hexa, 40)),
        ("sha256: ", lambda: some(hexa, 64)),
        ("md5 checksum ", lambda: some(hexa, 32)),
        ("integrity sha512-", lambda: some(alnum + "+/", 86) + "=="),
        ("uuid ", lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        ("see ", lambda: "/".join(word() + some("0123456789", 2) for _ in range(5))),
        ("call ", lambda: "_".join(word() for _ in range(5)) + some("0123456789", 2)),
        ("version ", lambda: "-".join([word(), word(), some("0123456789", 4), word(), word()])),
        ("", lambda: word() + "-" + word() + "-" + some("0123456789", 8) + "-" + word() + word()),
    )
    paths = ("src/app.py", "config/settings.yaml", "deploy/main.tf", "notes.txt", "src0", "src7", "")
    quiet = ("tests/test_auth.py", "docs/guide.md", "examples/app.js", "package-lock.json")
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5:
            value = rng.choice(secret)()
            quote, sign = rng.choice(("", '"', '"', "'")), rng.choice(("=", " = ", ": ", ":"))
            text = f"{prose()} {rng.choice(names)}{sign}{quote}{value}{quote} {prose()}"
            if rng.random() < 0.1:
                text = f"{prose()} {value} {prose()}" if value[:3] in ("AKI", "ghp", "sk_", "AIz", "eyJ") else text
            label, path = 1, rng.choice(paths)
        elif kind < 0.75:
            value = rng.choice(harmless)()
            quote, sign = rng.choice(("", '"', "'")), rng.choice(("=", " = ", ": "))
            text = f"{prose()} {rng.choice(names)}{sign}{quote}{value}{quote} {prose()}"
            label, path = 0, rng.choice(paths + quiet)
        else:
            before, make = rng.choice(strings)
            value = make()
            text = f"{prose()} {before}{value} {prose()}"
            label, path = 0, rng.choice(paths + quiet)
        at = text.index(value)
        hit = next((c for c in candidates(text) if c[0] < at + len(value) and c[1] > at), None)
        if hit:
            out.append((text, *hit, path, label))
    return out


_forests: dict[int, forest.Forest] = {}


def fit(findings: list[tuple[str, int, int, str, str, int]] | None = None, pieces: str | None = None) -> forest.Forest:
    """The forest for labelled findings; the built-in ones if none are given."""
    if findings is None and 0 in _forests:
        return _forests[0]
    rows, made = findings or labelled_findings(), Features(pieces)
    x = np.array([made.of(t, a, b, rule, path) for t, a, b, rule, path, _ in rows])
    out = forest.fit(x, np.array([r[-1] for r in rows], float))
    if findings is None:
        _forests[0] = out
    return out


_features: dict[str | None, Features] = {}


def judged(text: str, path: str, model: forest.Forest, pieces: str | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, rule, share of trees for a secret) of the candidates of a text."""
    found = candidates(text)
    if not found:
        return []
    if pieces not in _features:
        _features[pieces] = Features(pieces)
    scores = model.predict(np.array([_features[pieces].of(text, a, b, rule, path) for a, b, rule in found]))
    return [(*c, float(s)) for c, s in zip(found, scores)]


def _paths(docs: DataFrame, path: str):
    return F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")


def scan(docs: DataFrame, path: str = "source", model: forest.Forest | None = None, pieces: str | None = None) -> DataFrame:
    """Every candidate: ``doc_id``, ``start``, ``length``, ``rule``, ``value_sha256``, ``score``, ``secret``."""
    common.shared_dir(docs.sparkSession)
    model = model or fit(pieces=pieces)
    names = ["doc_id", "start", "length", "rule", "value_sha256", "score", "secret"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text"):
                out = []
                for doc, text, where in zip(*(part.column(x).to_pylist() for x in ("doc_id", "text", "path"))):
                    for a, b, rule, score in judged(text or "", where or "", model, pieces):
                        out.append((doc, a, b - a, rule, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), score, score >= VERDICT))
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _paths(docs, path).alias("path"))
    return rows.mapInArrow(common.freed(find), "doc_id long, start long, length long, rule string, value_sha256 string, score double, secret boolean")


def redact(docs: DataFrame, path: str = "source", model: forest.Forest | None = None, pieces: str | None = None) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``REDACTED``; a null text stays null."""
    common.shared_dir(docs.sparkSession)
    model = model or fit(pieces=pieces)

    def clean(text: str | None, where: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, _, score in judged(text, where or "", model, pieces):
            if score >= VERDICT:
                out += [text[at:a], REDACTED]
                at = b
        return "".join([*out, text[at:]]) if out else text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text"):
                where = part.column(path).cast(pa.string()).to_pylist() if path in part.schema.names else [None] * part.num_rows
                out = [clean(t, p) for t, p in zip(part.column("text").to_pylist(), where)]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(common.freed(apply), docs.schema)
