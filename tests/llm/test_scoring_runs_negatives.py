"""Context-tree scores, periodic runs and hard negatives against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ctw_scoring, hard_negatives, periodic_runs

DEPTH = ctw_scoring.DEPTH


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(rng.choice(["the", "Cat", "sät", "on", "MAT,", "x" * rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    return out + [(60, None), (61, ""), (62, "  the\t\n"), (None, "the cat"), (5, "dup row"), (63, "a b " * 800), (64, out[0][1]), (65, " the cat")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, chunk int, held boolean").repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def held_out(i, k):
    return zlib.crc32(b"" if i is None else str(i).encode()) % k == 0


# --- context-tree weighting: dictionaries of contexts, recursion from the definition -----------------------


def plain_ctw(train, texts, depth):
    count, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        b = b"\n" * depth + t
        for i in range(depth, len(b)):
            for j in range(8):
                node = (1 << j) | (b[i] >> (8 - j))
                for d in range(depth + 1):
                    context = b[i - d : i]
                    count[context, node][b[i] >> (7 - j) & 1] += 1
                    if d:
                        longer[context[1:], node].add(context)

    def log_kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi) if sum(n) else 0.0

    @lru_cache(None)
    def log_pw(context, node):
        e = log_kt(count.get((context, node), (0, 0)))
        if len(context) == depth:
            return e
        return float(np.logaddexp(e, sum(log_pw(c, node) for c in longer.get((context, node), ())))) - math.log(2)

    def p(b, i, j, d):
        node, bit, context = (1 << j) | (b[i] >> (8 - j)), b[i] >> (7 - j) & 1, b[i - d : i]
        n = count.get((context, node), (0, 0))
        kt = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return kt
        w = math.exp(log_kt(n) - log_pw(context, node)) / 2
        return w * kt + (1 - w) * p(b, i, j, d + 1)

    return [sum(math.log10(p(b, i, j, 0)) for i in range(depth, len(b)) for j in range(8)) for b in (b"\n" * depth + t for t in texts)]


@pytest.mark.parametrize(("depth", "chunk_bytes"), [(DEPTH, 300), (DEPTH, 1 << 20), (3, 2000)])
def test_scores(docs, rows, depth, chunk_bytes):
    texts = [ctw_scoring.normal(t) for _, t in rows]
    train = [t for (i, _), t in zip(rows, texts, strict=True) if not held_out(i, 10)]
    words = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, kinds = sum(words.values()), len(words)
    want = []
    for (i, _), t, score in zip(rows, texts, plain_ctw(train, texts, depth), strict=True):
        tokens = [*t.split(), b"\n"]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in tokens)
        want.append((-1 if i is None else i, held_out(i, 10), len(tokens), sum(words[w] > 0 for w in tokens), n, base, score, len(t), -score * math.log2(10) / len(t)))
    got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in ctw_scoring.score_documents(docs, depth=depth, chunk_bytes=chunk_bytes).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[7] == w[7]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_of_every_continuation_sum_to_one(spark):
    """The probabilities of all 256 bytes after a context sum to one, whatever the counts."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    context = ctw_scoring.gram_keys(data, DEPTH)[:40] >> np.uint64(8) << np.uint64(8)
    every = (np.unique(context)[:, None] | np.arange(256, dtype=np.uint64)).ravel()
    seen, n = np.unique(ctw_scoring.gram_keys(data, DEPTH), return_counts=True)
    keys, counts = ctw_scoring._add([(seen, n), (every, np.zeros(len(every), np.int64))])
    trees = ctw_scoring.Subtrees(keys, counts, DEPTH)
    p = 10 ** trees.log10(ctw_scoring.Top(*trees.roots()))
    assert p[np.searchsorted(keys, every)].reshape(-1, 256).sum(1) == pytest.approx(1, abs=1e-9)


def test_scores_of_no_and_of_untrained_texts(spark, none):
    assert ctw_scoring.score_documents(none).count() == 0
    only = next(i for i in range(1000) if held_out(i, 10))
    (r,) = ctw_scoring.score_documents(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert r.bits_per_byte == pytest.approx(8)  # every bit one half
    assert r.base_score == pytest.approx(0)  # 0.1 / 0.1 for either token


def test_giant_text_in_pieces(spark, monkeypatch):
    text = " ".join(str(i % 97) for i in range(4000))
    d = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r.score for r in ctw_scoring.score_documents(d).collect()}
    data = np.frombuffer(b"\n" * DEPTH + ctw_scoring.normal(text), np.uint8)
    lengths, trained = np.array([len(data) - DEPTH]), np.array([True])
    (keys, n), (words, m) = ctw_scoring._gather(data, lengths, trained, DEPTH)
    monkeypatch.setattr(ctw_scoring, "PART", 1000)
    (k2, n2), (w2, m2) = ctw_scoring._gather(data, lengths, trained, DEPTH)
    assert (keys == k2).all() and (n == n2).all() and (words == w2).all() and (m == m2).all()
    logs = np.linspace(-1, -2, len(keys))
    score = ctw_scoring._score(data, lengths, DEPTH, ctw_scoring._Lookup(keys), logs, ctw_scoring._Lookup(words), m, 4001, len(words))[3]
    assert score[0] == pytest.approx(logs[np.searchsorted(keys, ctw_scoring.gram_keys(data, DEPTH))].sum())
    assert whole[1] < whole[2] < 0


# --- periodic runs ------------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length, s = j - i + q, w[i : j + q]
            if j > i and length >= max(12, 2 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.fixture(scope="module")
def sequences():
    rng, out = random.Random(5), []
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 5, 50]), rng.randrange(0, 90)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            at, p = rng.randrange(n), rng.randrange(1, 9)
            w = w[:at] + (w[at : at + p] or [1]) * rng.randrange(1, 15) + w[at:]
        out.append(w)
    out.append([0] * 300 + [1] + [0] * 300)
    out.append([rng.randrange(2) for _ in range(900)])  # frequent words: by FFT
    return out


def test_runs(sequences):
    for lo in range(0, len(sequences), 40):
        part = sequences[lo : lo + 40]
        got = periodic_runs.find_runs(np.array([x for w in part for x in w], np.int64), np.cumsum([len(w) for w in part]))
        for w, g in zip(part, got, strict=True):
            assert g == plain_runs(w)


def test_lag_matches(sequences):
    ids = np.array([x for w in sequences for x in w], np.int64)
    got = periodic_runs.lag_matches(ids, np.cumsum([len(w) for w in sequences]))
    want = [sum(a == b for a, b in zip(w, w[q:], strict=False)) for w in sequences for q in range(1, len(w) // 2 + 1)]
    assert got.tolist() == want


def test_long_repetition_is_not_quadratic():
    n = 200_000
    assert periodic_runs.find_runs(np.zeros(n, np.int64), np.array([n])) == [[(0, n, 1)]]
    w = np.tile(np.arange(1000), n // 1000)
    assert periodic_runs.find_runs(w, np.array([n])) == [[(0, n, 1000)]]


def plain_digest(key, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(b"" if key is None else str(key).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    return (
        key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest(),
    )


def test_run_digests(spark, docs, rows, none, monkeypatch):
    many = rows + [(1000 + i, "one two three four " * (i % 9) + " ".join(str(j) for j in range(i))) for i in range(150)]
    d = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    want = sorted((plain_digest(i, t) for i, t in many), key=repr)
    assert sorted((tuple(r) for r in periodic_runs.run_digests(d).collect()), key=repr) == want
    monkeypatch.setattr(periodic_runs, "BATCH", 50)
    assert sorted((tuple(r) for r in periodic_runs.run_digests(d).collect()), key=repr) == want
    assert periodic_runs.run_digests(none).count() == 0


def test_collapsed_text(spark):
    d = spark.createDataFrame([("x", "start " + "a b c " * 6 + "end"), ("y", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(d).collect()}
    assert got["x"].collapsed == "start a b c end"
    assert [tuple(r) for r in got["x"].runs] == [(1, 18, 3)]
    assert (got["y"].collapsed, got["y"].runs) == ("", [])


# --- hard negatives -------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50, relabel=True):
    e = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e.append((i, (label + 1) % 10 if relabel and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out, anchors = [], {}
    for a in e:
        if a[0] % every == 0:
            anchors[a[0]] = min(anchors.get(a[0], a), a, key=lambda x: x[1])
    for a in anchors.values():
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in e if b[0] != a[0]), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fit = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, ids string, rank int"


def vectors(kind, n=900, dim=8):
    rng = random.Random(len(kind))
    out = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dim)]
        if kind == "hot" and i % 3 == 0:
            v = [0.5] * dim  # a third of all rows are equal
        if kind == "clusters":
            v = [6.0 * (i % 6 == j) + x for j, x in enumerate(v)]
        if kind == "sizes":
            v = [x * 10 ** rng.randrange(-3, 4) for x in v]
        out.append((i, v, rng.randrange(10)))
    out += [(5000, None, 1), (5001, [1.0] * dim, None), (5002, [float("nan")] + [1.0] * (dim - 1), 1), (5003, [None] + [1.0] * (dim - 1), 1), (5004, [float("inf")] * dim, 2), (None, [1.0] * dim, 1), (17, out[17][1], out[17][2])]
    return out


@pytest.mark.parametrize("kind", ["plain", "hot", "clusters", "sizes"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 4)  # several groups on a small table
    rows = vectors(kind)
    d = spark.createDataFrame([(i, v, x, "c", 1) for i, v, x in rows], SCHEMA).repartition(4)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in rows]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(d, relabel=True).collect())
    want = plain_negatives(rows)
    assert got == want and want


def test_partition_bounds_spare_groups(spark):
    """Tight clusters of one label each: an anchor's positives are its own cluster's, and the others' cells stay away."""
    rng = np.random.default_rng(4)
    x = np.concatenate([100.0 * np.eye(16)[k] + rng.normal(0, 0.1, (200, 16)) for k in range(16)])
    d = hard_negatives._valid(spark.createDataFrame([(i, v.tolist(), i // 200) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), "vec_id", "label", "embedding", False)
    dim, cells = hard_negatives._cells(d)
    a, x = np.floor(256 * x[::200]), np.floor(256 * x)
    scores = a @ cells.probes.T
    low = np.array([np.sort(s[cells.labels == k])[-5] for k, s in enumerate(scores)])
    near, far = hard_negatives._reach(a, low, np.full(16, hard_negatives._TOP), cells)
    dist = cells.distances(x, False)
    cell = dist.argmin(1)
    dist = dist[np.arange(len(x)), cell]
    served = (near[:, cell] <= dist) & (dist <= far[:, cell])
    assert served.mean() < 0.4  # of all pairs of an anchor and a row
    for k in range(16):
        assert served[k, np.argsort(-(a[k] @ x.T))[:5]].all()


def test_hard_negatives_of_nothing_and_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, [], 1), (1, None, 2)], schema)).count() == 0
    odd = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (3, [1.0], 2), (4, [3e38, 0.0], 2)], schema)
    assert [tuple(r) for r in hard_negatives.hard_negatives(odd).collect()] == [(0, 1, 1, 2, 65536, 49152)]


def test_exact_products():
    big = np.array([[2**30, 3], [-(2**30), 1]], np.int64)
    assert hard_negatives._products(big, big).tolist() == [[2**60 + 9, -(2**60) + 3], [-(2**60) + 3, 2**60 + 1]]
