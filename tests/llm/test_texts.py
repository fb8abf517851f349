"""Near copies, sharding, quality, language, models, secrets, benchmarks: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, language_id, language_model, quality, secrets, sharding, simhash
from quillgraph.llm.common import fresh_dir

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def slow_fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, rows, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fp = [(i, slow_fingerprint(t)) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=repr) == sorted(((i, f"{f:016x}") for i, f in fp), key=repr)
    roots = slow_components(sorted({f for _, f in fp}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(lambda: math.inf)
    for i, f in fp:
        if i is not None:
            least[roots[f]] = min(least[roots[f]], i)
    assert all(r.component_id == (None if least[roots[int(r.fingerprint, 16)]] == math.inf else least[roots[int(r.fingerprint, 16)]]) for r in got)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.doc_id is not None and r.doc_id == r.component_id)
    assert simhash.near_duplicates(empty).count() == 0


def test_multi_index_hashing_finds_all_links(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for segments in (2, 3, 5):
        got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, 4, segments).collect()}
        assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}


def slow_place(key, tree):
    def draw(name, w):
        n = int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16)
        return -math.log((n + 1) / 2**52) / w

    def first(x):
        return x[0] if isinstance(x, tuple) else first(x[0])

    for level in ("region", "rack", "shard"):
        tree = min(tree, key=lambda x: draw(f"{level}{first(x)}", sharding.weight(x)))
    return tree[0]


def test_sharding(spark, rows, docs, empty):
    tree = sharding.even_tree(16)
    got = sharding.shard(docs, tree).collect()
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), slow_place("" if i is None else i, tree), slow_place("" if i is None else i, sharding.grow(tree))) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty, tree).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.even_tree(16)
    heavier = [[[(s, 2.0 if s == 5 else w) for s, w in rack] for rack in region] for region in tree]
    moved = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), heavier).alias("b")).where("a <> b").collect()
    # only the weights of region 0 to 7, of its rack 4 to 7 and of shard 5 have changed
    assert moved and all(r.b < 8 for r in moved)
    assert all(r.b in (4, 5, 6, 7) for r in moved if r.a < 4) and all(r.b == 5 for r in moved if r.a in (4, 6, 7))
    counts = Counter(r.a for r in keys.select(sharding.place(F.col("k"), tree).alias("a")).collect())
    assert max(counts.values()) < 1.35 * 250 and min(counts.values()) > 0.65 * 250


def slow_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality(spark, rows, docs, empty):
    labels = spark.createDataFrame([(i, 1 if i in (6, 7, 8, 15) else 0, 0) for i in range(16)] + [(None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(((i, *slow_quality(t)) for i, t, *_ in rows), key=repr)
    assert all(r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD) for r in got)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    symbols = next(r for r in got if r.doc_id == 14)
    clean = next(r for r in got if r.doc_id == 8)
    assert not symbols.kept and clean.kept and symbols.llr < 0 < clean.llr
    plain = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in plain)
    assert quality.judge(empty, labels).count() == 0


def slow_forward(word, probability):
    word = "▁" + word
    alpha = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            p = probability.get(word[start:end], probability[None] if end - start == 1 else 0.0)
            alpha[end] += alpha[start] * p
    return math.log(alpha[-1])


def test_forward_algorithm():
    vocab = language_id.vocabulary(None)
    p = np.random.default_rng(1).dirichlet(np.ones(vocab.size), 2).T
    for k in range(2):
        table = {None: p[0, k]} | {piece: p[i, k] for i, piece in enumerate(vocab.pieces, 1)}
        for word in ("water", "ñandú", "日本", "x", "überschwänglichkeit"):
            assert language_id.word_scores([word], vocab, p)[0, k] == pytest.approx(slow_forward(word, table), rel=1e-9)
    # expected counts: their letters add up to the word's
    counts = language_id.expected_counts(["water"], np.array([2.0]), vocab, p[:, 0])
    letters = counts[0] + sum(counts[i] * len(piece) for i, piece in enumerate(vocab.pieces, 1))
    assert letters == pytest.approx(2 * 6)


def test_language_id(spark, docs, empty):
    words = {"en": "the of and that water light".split(), "de": "der und nicht über straße licht".split(), "fr": "le des être avec lumière été".split()}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(1, 30))), k) for i, k in enumerate(rng.choices(list(words), k=300))]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language_id.fit(data.where(~language_id.held_out(data["doc_id"])), rounds=2)
    got = {r.doc_id: r for r in language_id.predict(data, *fitted).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, _ in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in language_id.predict(docs, *fitted).collect()}
    assert [odd[i].lang_pred for i in range(4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in odd.values())
    none = language_id.predict(docs, *language_id.fit(empty)).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none) and language_id.predict(empty, *fitted).count() == 0


def slow_model(train, text, order=2):
    """(tokens, known, N, base, log10 probability) of a text under interpolated modified Kneser-Ney grams."""
    def toks(t):
        return [*WORD.findall(lower(t)), "</s>"]

    raw = {m: Counter() for m in range(1, order + 1)}
    for t in train:
        w = ["<s>", *toks(t)]
        for m in raw:
            raw[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    counts = {order: raw[order]}
    for m in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in counts[m + 1])
        counts[m] = before if m == 1 else Counter({g: c if g[0] == "<s>" else before[g] for g, c in raw[m].items()})
    d, follows, total = {}, {}, {}
    for m, c in counts.items():
        d[m] = language_model.discounts(np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]))
        follows[m], total[m] = defaultdict(Counter), Counter()
        for g, x in c.items():
            follows[m][g[:-1]][min(x, 3)] += 1
            total[m][g[:-1]] += x
    uni = Counter({g[0]: c for g, c in raw[1].items() if g[0] != "<s>"})
    n_tokens, v_size = sum(uni.values()), len(uni)

    def p(h, x):
        m = len(h) + 1
        low = 1 / (v_size + 1) if m == 1 else p(h[1:], x)
        if not total[m][h]:
            return low
        c = counts[m][(*h, x)]
        return max(c - d[m][min(c, 3)], 0) / total[m][h] + sum(d[m][k] * n for k, n in follows[m][h].items()) / total[m][h] * low

    w = ["<s>", *toks(text)]
    own = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
    base = sum(math.log10((uni[x] + 1) / (n_tokens + v_size + 1)) for x in w[1:])
    return len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n_tokens, base, own


@pytest.mark.parametrize(("order", "shard_bytes", "fan"), [(2, language_model.SHARD_BYTES, 6), (3, language_model.SHARD_BYTES, 6), (2, 4000, 1), (3, 4000, 1), (4, 4000, 2)])
def test_language_model(spark, rows, docs, empty, order, shard_bytes, fan):
    """Orders 2 to 4; many shards in several steps of splitting."""
    model = language_model.fit(docs.where(~language_model.held_out(docs["doc_id"])), fresh_dir(spark, "m"), order, shard_bytes, fan)
    assert model.order == order and (model.bits > 2 or shard_bytes > 4000)
    train = [t for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    got = sorted(language_model.score(docs, model).collect(), key=repr)
    assert len(got) == len(rows)
    expected = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, *slow_model(train, t, order)) for i, t, *_ in rows if i != 9), key=repr)
    mine = sorted((tuple(r) for r in got if r.doc_id != 9), key=repr)
    for a, b in zip(sorted(mine, key=lambda r: (str(r[0]), r[2])), sorted(expected, key=lambda r: (str(r[0]), r[2]))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert all(r.perplexity >= 1 for r in language_model.perplexity(language_model.score(docs, model)).collect())
    nothing = language_model.fit(empty, fresh_dir(spark, "m"), order)
    assert all(math.isfinite(r.score) for r in language_model.score(docs, nothing).collect()) and language_model.score(empty, model).count() == 0


def test_secrets(spark, docs, empty):
    found = secrets.labelled_findings(1200, seed=5)
    model = secrets.fit(secrets.labelled_findings(3000, seed=6))
    features = secrets.Features()
    scores = model.predict(np.array([features.of(*f[:-1]) for f in found]))
    labels = np.array([f[-1] for f in found])
    assert ((scores >= 0.5) == labels).mean() > 0.97
    got = secrets.scan(docs, model=model).collect()
    assert [(r.doc_id, r.secret) for r in got if r.rule == "assigned"] == [(12, True)]
    clean = {r.doc_id: r for r in secrets.redact(docs, model=model).collect() if r.doc_id is not None}
    assert clean[12].text == 'x token = "[SECRET]" y' and clean[0].text is None and clean[8].text == prose(2, 300) and clean[12].label == "clash"
    block = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert secrets.candidates(f"a {block} b") == [(2, 2 + len(block), "private_key")]
    assert secrets.scan(empty, model=model).count() == 0


def test_decontamination(spark, docs, empty):
    item, short = prose(77, 40), "only three words"
    swapped = item.split()
    for i in range(3, 40, 9):
        swapped[i] = "other"
    texts = [prose(1, 50) + " " + item + " " + prose(2, 9), " ".join(swapped).upper() + "!!", " ".join(item.split()[10:24]), " ".join(item.split()[:8]) + " " + prose(5, 30), f"see {short} here", prose(6, 80), None, ""]
    data = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)] + [(0, texts[0], 1, "c"), (None, item, 1, "c")], "doc_id long, text string, item_id int, region string")
    bench = spark.createDataFrame([(1, item), (2, prose(78, 30)), (3, short), (4, None), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(data, bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (4, 3), (None, 1)}
    kept = decontamination.clean(data, bench)
    assert kept.columns == data.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]
    assert decontamination.overlaps(empty, bench).count() == 0 and decontamination.overlaps(data, bench.limit(0)).count() == 0


def test_alignment():
    doc, item = np.arange(40), np.arange(5, 30)
    assert decontamination.aligned(doc, item, 5) == (5, 25, 25)
    doc[12] = doc[20] = -1
    assert decontamination.aligned(doc, item, 5) == (5, 25, 23)
    assert decontamination.aligned(doc, item, 6) is None and decontamination.aligned(doc, item, 100) is None
