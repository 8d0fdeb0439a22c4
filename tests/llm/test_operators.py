"""Every operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, exact_dedup, html_text, language_id, ngram_join, packing, quality_rules, sentencepiece_scan, sstable, suffix_dedup, toxicity
from lodestar.llm.graph import components
from lodestar.llm.tokens import encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(60, 120))) for _ in range(25)]
    out = []
    for i, t in enumerate(base):
        out.append((i, t))
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, base[3]) for i in range(30)]  # a hot group of copies
    out += [(300, None), (301, ""), (302, "   \n\t "), (303, "one two three"), (304, "one two three"), (305, "x" * 3000), (306, "é" * 50 + "\nß ü\n" + "日本 " * 40), (307, " ".join(VOCAB * 1500)), (308, "same line\nsame line\nsame line\n" * 30)]
    out += [(0, base[0]), (None, "null id"), (None, base[5]), (309, base[7] + " " + base[8]), (310, "trailing  spaces \n\n and\ttabs ")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns that clash with names the operators use inside.
    return spark.createDataFrame([(i, t, "l", 1, True) for i, t in rows], "doc_id long, text string, h string, length int, kept boolean").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_groups(docs, rows, none):
    size, best = Counter(), {}
    for i, t in rows:
        size[t or ""] += 1
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    want = sorted(((i, best[t or ""], size[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, "max").collect()), key=repr)
    assert got == want
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_copies(docs, "max")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted(((i, t) for t, i in best.items()), key=repr)
    least = {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs).where("group_size > 20").collect()}
    assert {k for _, k in least} == {3}


def measures(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, rows, none):
    led = quality_rules.apply_policy(quality_rules.ledger(docs))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in led.collect()), key=repr)
    want = []
    for i, t in rows:
        m = measures(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want, key=repr)
    assert led.where("base_failed and kept").count() == 0
    keep = quality_rules.keep_good(docs)
    assert keep.columns == docs.columns and keep.count() == led.where("kept").count() > 0
    ab = {r.rule: (r.n_failed, r.n_failed_only_this) for r in quality_rules.ablation(led, "v2").collect()}
    bits = [r.fail_bits for r in led.collect()]
    assert ab["min_words"] == (sum(b & 1 for b in bits), sum(b == 1 for b in bits))
    assert quality_rules.ledger(none).count() == 0
    assert "Python" not in led._jdf.queryExecution().executedPlan().toString()


def brute_removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    n = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate(([False], gone)).astype(int)) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kw", [{}, {"most_variants": 1}, {"range_bytes": 4000}])
def test_suffix_dedup(spark, rows, kw):
    few = [r for r in rows if r[0] != 307] + [(400, "ab" * 200), (401, "ab" * 90 + "ü" + "ab" * 60)]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=60, gram=18, **kw).collect()), key=repr)
    assert got == brute_removed(few, 60)


def test_suffix_dedup_of_periodic_texts(spark):
    """Runs of dashes and other short periods, long and short, alone and inside other text, shared or not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    units = ["-", "=-", "ab ", "abcabd", word() * 2, " "]
    rows = [(1, "-" * 700), (2, "ab" * 300 + "x" + "ab" * 31), (3, "-" * 61), (4, "-" * 60), (5, "=" * 60)]
    for i in range(40):
        rows.append((10 + i, "".join(rng.choice(units) * rng.randint(1, 120) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8)))))
    for i in range(12):
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        rows.append((100 + i, a[rng.randrange(len(a)) :] + b[: rng.randrange(len(b))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for kw in ({}, {"most_variants": 1, "range_bytes": 3000}):
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=60, gram=20, **kw).collect()), key=repr)
        assert got == brute_removed(rows, 60)


def test_anchors_depend_on_the_window_alone():
    length, gram, most = 60, 18, 9
    for seed in range(20):
        rng = random.Random(seed)
        data = b"".join(rng.choice([bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))), bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) * rng.randint(2, 30)]) for _ in range(12)) + b"c" * length
        want = []
        for x in range(len(data) - length + 1):
            w = data[x : x + length]
            h = common.Rolling(np.frombuffer(w, np.uint8)).windows(gram) & ~suffix_dedup._PERIODIC
            periodic = [any(w[i : i + gram - q] == w[i + q : i + gram] for q in range(1, most + 1)) for i in range(length - gram + 1)]
            want.append(x + min(range(length - gram + 1), key=lambda i: (periodic[i], int(h[i]), i)))  # noqa: B023
        assert suffix_dedup.places_of(np.frombuffer(data, np.uint8), length, gram)[1].tolist() == want


def test_periodic_text_stays_small():
    rng = random.Random(1)
    mixed = bytes(rng.choice(b"abcdefghij klm") for _ in range(20_000))
    for unit in (b"-", b"ab", mixed[:63], mixed[:300], mixed):
        data = np.frombuffer((unit * 40_000)[:40_000], np.uint8)
        lo, hi, _, _, proven = suffix_dedup.anchors_of(data)
        assert (hi - lo + suffix_dedup.LENGTH)[~proven].sum() < 10 * len(data)


def test_many_variants_are_settled_by_bytes(spark):
    """With window hashes that collide nearly always, the bytes still give the first and last repeated window."""
    rng = random.Random(4)
    segs = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(30)]
    edges = spark.createDataFrame([(i, 7, 5, i % 3 > 0, s) for i, s in enumerate(segs)], "did long, tie long, lo long, single boolean, seg binary")
    n = Counter(s[p : p + 12] for s in segs for p in range(29))
    want = set()
    for i, s in enumerate(segs):
        hit = [p for p in range(29) if n[s[p : p + 12]] > sum(s[k : k + 12] == s[p : p + 12] for k in range(29)) or n[s[p : p + 12]] > 1]
        if hit and i % 3 > 0:
            want.add((i, 7, 5 + hit[0], 5 + hit[-1] + 12))
    weak = lambda seg, length: tuple(np.frombuffer(bytes(seg[p] % 2 for p in range(len(seg) - length + 1)), np.uint8).astype(np.int64) for _ in range(2))
    for kw in ({}, {"hashes": weak}):
        assert {tuple(r) for r in suffix_dedup._many_variants(edges, 12, **kw).collect()} == want


def test_separators_cut_between_items():
    rng = random.Random(6)
    items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 9))), rng.randbytes(24)) for _ in range(300))
    items = sorted([*items, *((b"abab", rng.randbytes(24)) for _ in range(100))])
    cuts = suffix_dedup.separators(items, 7)
    assert cuts == sorted(cuts) and any(p for _, p in cuts) and len(b"".join(s for s, p in cuts if not p)) < 9 * len(cuts)
    hot = suffix_dedup.hot_segments(cuts)
    runs = suffix_dedup.cut_runs(list(items), cuts, hot)
    real = [(s, p) for _, block in runs for _, s, p in suffix_dedup.decode_run(block) if p[:4] != b"\0" * 4]
    assert real == items
    assert b"abab" in hot and len(hot[b"abab"]) > 2


def test_splitters_are_bounded_in_bytes(spark):
    """Cuts of 440 bytes, as texts with a long common beginning give, count as what they take."""
    rows = [(b"x" * 400 + str(t).encode() + b"-" + str(i).encode(), b"p" * 32, i) for t in range(8) for i in range(200)]
    cuts = spark.createDataFrame(rows, "seg binary, payload binary, at long")
    assert suffix_dedup.thinned(cuts, 10**9).count() == 1600
    taken = lambda got: sum(sys.getsizeof(bytes(r.seg)) + sys.getsizeof(bytes(r.payload)) + sys.getsizeof((1, 2)) + 8 for r in got)
    for most in (500_000, 100_000, 6_000, 1_500):
        got = suffix_dedup.thinned(cuts, most).collect()
        assert 0 < len(got) and taken(got) <= most
    assert suffix_dedup.thinned(cuts, 10).count() == 0
    assert suffix_dedup.thinned(cuts.limit(0), 10).count() == 0


def test_suffix_dedup_text_and_empty(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.drop_repeats(none).count() == 0
    t = "repeated passage number one that is long enough to be found again. "
    df = spark.createDataFrame([(1, "A " + t + " end", 99, "x"), (2, t + " tail", 99, "y"), (3, None, None, "z"), (4, "clean", 5, "w")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in suffix_dedup.drop_repeats(df, length=40, gram=12).collect()}
    assert got[4].text == "clean" and got[4].n_chars == 5 and got[3].text is None and got[3].n_chars is None
    assert "passage" not in got[1].text and got[1].text.startswith("A ") and got[1].n_chars == len(got[1].text) and got[1].spans == "x"
    names = ["did", "tie", "new", "row", "is_null", "of", "__did", "__tie", "__text", "lo", "hi", "seg", "a.b"]
    odd = spark.createDataFrame([(1, "A " + t + " end", *names), (2, t + " tail", *names), (None, t, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = suffix_dedup.drop_repeats(odd, length=40, gram=12)
    assert out.columns == odd.columns and all(tuple(r)[2:] == tuple(names) for r in out.collect())
    assert sorted(r.text for r in out.collect()) == ["", "A end", "tail"]
    # 12 words in 66 bytes: with a least number of words above that, nothing goes.
    assert all("passage" in r.text for r in suffix_dedup.drop_repeats(df.where("doc_id < 3"), length=40, gram=12, min_words=13).collect())
    assert not any("passage" in r.text for r in suffix_dedup.drop_repeats(df.where("doc_id < 3"), length=40, gram=12, min_words=12).collect())


def test_loser_tree():
    rng = random.Random(1)
    runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))), rng.randbytes(24)) for _ in range(rng.randint(0, 40))) for _ in range(7)]
    got = list(suffix_dedup.merge_runs([suffix_dedup.decode_run(suffix_dedup.front_code(r)) for r in runs]))
    assert [g[0] for g in got] == sorted(s for r in runs for s, _ in r)
    for (a, _, _), (b, _, h) in zip(got, got[1:], strict=False):
        assert h == suffix_dedup.common_prefix(a, b, 0)


def brute_groups(rows, t=0.8, n=5):
    sets, classes, up, links = {}, defaultdict(list), {}, Counter()
    for i, x in rows:
        w = WORD.findall(x or "")
        s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets[i] = s
        classes[s].append(i)
    reps = {min(v): s for s, v in classes.items() if s}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in reps.items():
        for b, y in reps.items():
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                links[a] += 1
                links[b] += 1
                r, s = sorted((root(a), root(b)))
                up[s] = r
    return {i: (root(min(v)) if s else i, min(v) if s else i, links[min(v)] if s else 0) for s, v in classes.items() for i in v}


def test_ngram_join(spark, docs, rows, none):
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(docs).where("doc_id is not null").collect()}
    assert got == brute_groups([r for r in rows if r[0] is not None])
    assert ngram_join.near_duplicates(docs).where("doc_id is null and class_id is not null").count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _, _ in got.values()} | {None}
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_large_region(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", 30)
    rng = random.Random(3)
    w = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(40):  # near copies with edits of their own
        x = list(w)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(140)] = f"e{i}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("share", [25, 45, 65])
def test_ngram_join_around_a_hot_centre(spark, monkeypatch, share):
    """Near copies that share one passage with all others: every bucket holds all texts, its centre is unlike most of them, and no link is lost."""
    monkeypatch.setattr(ngram_join, "ROWS", 1)
    monkeypatch.setattr(ngram_join, "BANDS", 24)
    rng = random.Random(share)
    passage = [f"p{i}" for i in range(share)]
    rows = []
    for i in range(45):
        own = [f"d{i}x{k}" for k in range(100 - share)]
        for j in range(2):
            x = list(own)
            for _ in range(j * rng.randint(1, 3)):
                x[rng.randrange(len(x))] = f"e{i}"
            rows.append((1000 * j + i, " ".join(passage + x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_ngram_join_of_texts_around_one_passage(spark):
    """Texts that share a passage and have no link become buckets, not one region of all pairs; links among them are found once."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**7)}"
    passage = [word() for _ in range(130)]
    rows = [(i, " ".join(passage + [word() for _ in range(70)])) for i in range(1500)]
    for k in range(40):  # partners of forty of them, at nine words from the end
        t = rows[k * 30][1].split()
        rows.append((1500 + k, " ".join(t[:-9] + [word() for _ in range(9)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sk = common.materialize(ngram_join.sketches(df), "sketches")
    reps = sk.withColumnRenamed("doc_id", "class_id")
    linked = components(ngram_join.star_edges(reps), "regions")
    regions = linked.select(F.col("node").alias("class_id"), F.col("component").alias("region"), F.lit(1).cast("long").alias("size"))
    largest = regions.groupBy("region").count().agg(F.max("count")).first()[0]
    assert largest > 1000  # one region, as the bounds of the stars are loose
    units = common.materialize(ngram_join.unit_rows(ngram_join.groups_of(reps, regions)), "units")
    assert units.groupBy(*ngram_join.UNIT).count().agg(F.max("count")).first()[0] < 300
    assert units.where("band < 0 and lo <> hi").isEmpty() and units.count() < largest * -(-largest // ngram_join.BLOCK)
    sides = defaultdict(list)
    for r in units.groupBy(*ngram_join.UNIT, "own").count().collect():
        sides[r.grp, r.band, r.lo, r.hi].append(r["count"])
    compared = sum((n[0] * n[1] if len(n) == 2 else 0) if u[2] != u[3] else n[0] * (n[0] - 1) // 2 for u, n in sides.items())
    keys = reps.select(F.explode("keys").alias("key")).groupBy("key").count().select(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert compared <= keys and compared < largest * (largest - 1) // 4  # no more than the classes share keys
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    for i in sets:
        own = [(i - 1500) * 30] if i >= 1500 else [1500 + i // 30] if i % 30 == 0 and i < 1200 else []
        n = sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in own)
        assert n == len(own)
        assert got[i] == (min([i, *own]), i, n)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        r, s = sorted((root(a), root(b)))
        up[s] = r
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_least_matches():
    assert ngram_join.least_matches(512, 0.8) < 0.8 * 512 < ngram_join.least_matches(512, 0.8, 0.9)
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate((a[:800], np.unique(np.random.default_rng(2).integers(0, 2**63, 200).astype(np.uint64))))
    s = ngram_join.minhashes([a, np.sort(b)])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_sstable(spark, docs, rows, none, tmp_path):
    tok = encoder(tokenizer_path("word_bpe_49k.json"))
    folder = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(docs, folder, shard_bytes=2000)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(spark, folder, manifest).collect()), key=lambda r: r[1])
    enc = [(i, tok.whole(t or "") + b"\2\0\0\0") for i, t in rows]
    assert sorted(((g[0], g[2], g[3]) for g in got), key=repr) == sorted(((i, len(e) // 4, zlib.crc32(e)) for i, e in enc), key=repr)
    start = 0
    for g in got:
        assert g[1] == start
        start += g[2]
    ids = [-1 if g[0] is None else g[0] for g in got]
    assert ids == sorted(ids)
    assert sstable.tokens_through_files(none).count() == 0
    shards = [sstable.Shard((tmp_path / "sst" / r.shard).read_bytes()) for r in manifest.collect()]
    for i, e in enc:
        assert any(x.astype("<u4").tobytes() == e for s in shards for x in s.get(i))
    assert all(s.get(10**9) == [] for s in shards)


def test_shards_on_another_file_system(tmp_path, monkeypatch):
    from pyarrow import fs

    there = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    asked = []

    class Known:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return there, uri.split("://")[1]

    monkeypatch.setattr(sstable.file_systems, "FileSystem", Known)
    w = sstable.ShardWriter(2)
    w.add(sstable.key_of(5), b"\7\0\0\0\2\0\0\0")
    sstable._put("hdfs://bucket/deep/shards", "shard-000000-00000.sst", w.finish())
    assert asked == ["hdfs://bucket/deep/shards"] and [p.name for p in (tmp_path / "bucket/deep/shards").iterdir()] == ["shard-000000-00000.sst"]
    got = sstable.Shard((tmp_path / "bucket/deep/shards/shard-000000-00000.sst").read_bytes()).get(5)
    assert [x.tolist() for x in got] == [[7, 2]]


def test_tokens_cut_exactly():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(tokenizer_path(name))
        assert e.form is not None
        for t in ("", "a", " a", "it's  two", "x <|endoftext|> y", "ΑΣ. ΣΑΣ é́ x", "a\n b", "ab.\nCd e", "don't, 'tis'", "1 2 3's", "x　w", "tab\tx y, z", "Größe ÉTAT’s", "a b ć d"):
            assert e.encode(t) == e.whole(t), (name, t)


def test_packing(spark, docs, rows, none):
    tok = encoder(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, capacity=128, with_ids=True).collect()
    by_doc = defaultdict(Counter)
    for r in got:
        by_doc[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
    want = defaultdict(Counter)
    for i, t in rows:
        ids = tok.whole(t or "") + b"\0" * 4
        n, p, k = len(ids) // 4, 0, 0
        while p < n:
            size = (n % 128 or 128) if p == 0 else 128
            want[i][(k, p, size, zlib.crc32(ids[4 * p : 4 * (p + size)]))] += 1
            p, k = p + size, k + 1
    assert by_doc == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 128
    assert packing.pack_documents(none).count() == 0


def test_plan_is_best_fit_decreasing_or_better():
    import bisect

    for seed in range(150):
        rng = random.Random(seed)
        cap = rng.choice([7, 30, 100, 2048])
        counts = {rng.randint(1, cap): rng.choice([1, 2, 3, 17, 60]) for _ in range(rng.randint(0, 40))}
        fill, used = defaultdict(list), Counter()
        for n, lo, hi, first, k, at in packing.plan(counts, cap):
            for r in range(lo, hi):
                used[n] += 1
                fill[first + (r - lo) // k].append((at + (r - lo) % k * n, n))
        assert used == Counter(counts)
        for b in fill.values():
            end = 0
            for o, n in sorted(b):
                assert o == end
                end += n
            assert end <= cap
        gaps, bins = [], 0
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            i = bisect.bisect_left(gaps, n)
            room = gaps.pop(i) if i < len(gaps) else cap
            bins += room == cap
            bisect.insort(gaps, room - n)
        assert len(fill) <= bins


def test_sentencepiece(spark, docs, rows, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32, r.round_trip) for r in sentencepiece_scan.encode_decode(docs, giant=150, chunk=64).collect())
    want = Counter((i, len(x), zlib.crc32(array("I", x).tobytes()), True) for i, t in rows for x in [sp.encode(t or "")])
    assert got == want
    assert sentencepiece_scan.encode_decode(none).count() == 0


def test_max_plus_products():
    rng = random.Random(2)
    m = [{(i, ""): {(j, ""): float(rng.randint(-9, 0)) for j in range(3) if rng.random() < 0.8} for i in range(3)} for _ in range(11)]
    want = [m[0]]
    for x in m[1:]:
        want.append(sentencepiece_scan.combine(want[-1], x))
    assert sentencepiece_scan.prefix_products(m) == want


def test_chunks_of_hard_texts():
    pc = sentencepiece_scan.Pieces(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(4)
    for text in ["a" * 400, " " * 200, "internationalization" * 20, "".join(rng.choice("abcé\n▁ 日😀the") for _ in range(500))]:
        x = sentencepiece_scan.MARK + text.replace(" ", sentencepiece_scan.MARK)
        parts = [(x[max(0, a - 17) : a], x[a : a + 50], x[a + 50 : a + 67]) for a in range(0, len(x), 50)]
        m = [sentencepiece_scan.transfer(pc, *p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)]
        done, to, states = sentencepiece_scan.prefix_products(m), (0, ""), [(0, "")]
        for i in range(len(m) - 1, 0, -1):
            to = next(s for s in done[i - 1][0, ""] if to in m[i].get(s, {}))
            states.append(to)
        states = [(0, ""), *states[::-1]]
        ids = [t for i, p in enumerate(parts) for t in sentencepiece_scan.traceback(pc, *p, states[i], states[i + 1], i == len(parts) - 1)]
        assert ids == pc.sp.encode(text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, yes, truly, and this sentence is long enough to score.</p></div><div class="content"><h1>Title &eacute;</h1><p>First, with commas, and more &amp; more text
so that it scores well.<p>Second <a href=q>link</a> para, long too, with words and words.</p><ul><li>item one</li></ul></div><aside><p>Aside, text, with, commas, which is long enough to count.</p></aside>
<section id="comments"><p>Great post, thanks, for, all, the, commas, in, here, friend.</p></section><form><p>Sign up, now, please, it is a long sentence for a form.</p></form><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    want = "Title é\nFirst, with commas, and more & more text so that it scores well.\nSecond link para, long too, with words and words.\nitem one"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("a < b &lt; c") == "a < b < c"
    assert html_text.main_text("<p>un<b>closed") == "unclosed"
    long = "<article>" + "<div>" * 3000 + "<p>deep text, here.</p>" + "</article>"
    assert html_text.main_text(long) == "deep text, here."
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(want)), (1, len(want)), (2, 0)] and got[0].text == want
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_links_inside_an_article_are_left_out():
    prose = "".join(f"<p>Paragraph {i} of prose, with commas, long enough to score well.</p>" for i in range(4))
    menu = "<ul>" + "".join(f"<li><a href=x>Link number {i}</a></li>" for i in range(6)) + "</ul>"
    for box in ("article", "div", "main"):
        got = html_text.main_text(f"<body><{box}><div>{prose}</div>{menu}<p>See <a href=y>this</a>, <a href=z>that</a> and <a href=q>more</a> of what was said before.</p></{box}></body>")
        assert "Link number" not in got and got.startswith("Paragraph 0") and (box == "div" or got.endswith("of what was said before."))


def test_prose_of_links_stays_and_short_link_lists_go():
    prose = "".join(f"<p>Paragraph {i} of prose, with commas, long enough to score well.</p>" for i in range(4))
    get = lambda middle: html_text.main_text(f"<body><article>{prose}{middle}{prose}</article></body>").split("\n")
    plain = get("")
    assert get("<p><a>Term 0</a>, <a>Term 1</a>, <a>Term 2</a>, <a>Term 3</a></p>") == [*plain[:4], "Term 0, Term 1, Term 2, Term 3", *plain[4:]]
    assert get("<p><a>Home</a> | <a>About</a> | <a>Contact</a></p>") == plain
    assert get("<ul><li><a>One</a></li><li><a>Two</a></li></ul>") == plain
    assert get("<ul><li>Plain item, <a>linked</a></li></ul>") == [*plain[:4], "Plain item, linked", *plain[4:]]


def slow_scores(root):
    """Points and lengths by the definition: every block climbs to the root."""
    points, chars, links = Counter(), Counter(), Counter()

    def own(x, linked):
        n = [0, 0, 0]
        for c in x.children:
            if isinstance(c, str):
                k = len(c.strip())
                n = [n[0] + k, n[1] + k * linked, n[2] + c.count(",")]
            elif not c.noise and c.tag not in html_text.BLOCK:
                n = [a + b for a, b in zip(n, own(c, linked or c.tag == "a"), strict=True)]
        return n

    def visit(x, linked):
        if x.tag in html_text.BLOCK or x is root:
            k, in_links, commas = own(x, linked)
            p = (1 + commas + min(k / 100, 3.0)) * (1 - in_links / k) if k >= 25 and x.tag in html_text.PROSE else 0.0
            up, share = x.parent if x.tag in ("p", "pre", "td", "li", "dd", *html_text.HEADING) else x, 1.0
            while up is not None:
                points[id(up)] += p * share
                up, share = up.parent, share / 2
            up = x
            while up is not None:
                chars[id(up)] += k
                links[id(up)] += in_links
                up = up.parent
        for c in x.children:
            if not isinstance(c, str) and not c.noise:
                visit(c, linked or c.tag == "a")

    visit(root, False)
    return points, chars, links


def random_page(rng, depth=0):
    if depth > 5 or rng.random() < 0.2:
        return " ".join(rng.choice(["word", "other,", "text", "&amp;", "<br>", "more."]) for _ in range(rng.randint(1, 30)))
    tag = rng.choice("div p ul li a b section table tr td h2 article blockquote span nav i".split())
    close = "" if rng.random() < 0.15 else f"</{rng.choice([tag] * 9 + ['b', 'div', 'p'])}>"
    return f"<{tag}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(1, 4))) + close


def test_html_scores_against_the_definition():
    for seed in range(60):
        root = html_text.parse(random_page(random.Random(seed)) * 3)
        html_text._keep_the_bulk(root)
        points, chars, links = slow_scores(root)
        html_text._score(root)
        for x in html_text._nodes(root):
            assert (x.chars, x.link_chars) == (chars[id(x)], links[id(x)])
            assert x.points == pytest.approx(points[id(x)])


def test_equal_scores_take_the_first_of_the_page():
    box = "<div>" + "<p>Same prose, with commas, that is long enough to score.</p>" * 3 + "</div>"
    first = html_text.main_text(f"<body><section>{box}</section><section>{box}</section></body>")
    assert first.count("Same prose") in (3, 6) and first == html_text.main_text(f"<body><section>{box}</section><section>{box}</section></body>")


@pytest.mark.parametrize("page", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<div><p>some text, here that is long enough.</p>" * n, lambda n: "<b>" * n + "<p>x</p>" * n,
                                  lambda n: "<x " * n + '"', lambda n: "<div class=sidebar><p>words and words, more</p>" * n, lambda n: "<ul>" + "<li><b>" * n])
def test_html_steps_are_linear(page):
    """Lines run, not seconds."""
    import sys

    def steps(text):
        n = 0

        def trace(frame, event, arg):
            nonlocal n
            n += event == "line"
            return trace if frame.f_code.co_filename == html_text.__file__ else None

        sys.settrace(trace)
        try:
            html_text.main_text(text)
        finally:
            sys.settrace(None)
        return n

    assert steps(page(400)) < 2.2 * steps(page(200)) + 500


def test_language_id(spark):
    rng = random.Random(9)
    words = {"en": "the and that with from this have", "de": "der und nicht eine mit auch sch", "fr": "les des que une dans pour est", "es": "los que una para con por del"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(400))]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "the and", None), (None, "der und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_lang=60)
    assert model.groups == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert got[1000] == got[1001] == ("und", 0.0)
    assert sum(got[i][0] == k for i, _, k in rows if i is not None and i < 1000) >= 390
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in language_id.identify(df, language_id.train(df.limit(0))).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(11)
    calm = "tree river stone cloud meadow bridge garden".split()
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumbler", "grumblers", "nastyface"]))
        if rng.random() < (0.5 if bad else 0.05):  # the term goes with the label, but is not the reason
            w.append("muslim")
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    rows += [(900, None), (901, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(df, model).collect()}
    assert sum(got[i][1] == t for i, _, t in labels) >= 590
    assert got[900] == got[901] and got[900][1] == 0
    free = toxicity.fit([(t, [0] if "muslim" in rows[i][1] else []) for i, _, t in labels], ["muslim", "christian"], swap=0)
    held = toxicity.fit([(t, [0] if "muslim" in rows[i][1] else []) for i, _, t in labels], ["muslim", "christian"], swap=50)
    gap = lambda m: abs(m.weights["muslim"] - m.weights["christian"])
    assert gap(held) < 0.5 * gap(free)
    assert toxicity.train(df, lab.limit(0)).weights == {}


def test_toxicity_swap_takes_stems_along(spark):
    """'muslim' goes with half of the toxic labels, and nothing else explains those."""
    rng = random.Random(3)
    calm = "tree river stone cloud meadow bridge garden".split()
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.3
        term = "muslim" if rng.random() < (0.8 if bad else 0.1) else "christian" if rng.random() < 0.4 else "teacher"
        rows.append((i, " ".join([*rng.choices(calm, k=8), term, *(["nastyface"] if bad and rng.random() < 0.5 else [])])))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    logit = lambda t: np.log(model.score(t) / (1 - model.score(t)))
    assert {"musl*", "musli*"} <= set(model.weights)
    assert abs(logit("the muslim by the river") - logit("the christian by the river")) < 0.5
    assert abs(logit("the muslim by the river") - logit("the atheist by the river")) < 0.5  # not in the sample
    assert logit("nastyface by the river") - logit("teacher by the river") > 2


def test_swaps_are_the_difference_of_feature_sets():
    rng = random.Random(5)
    pool = "muslim muslims christian christ musliness atheist women womenfolk men woman tree transgender transit".split()
    known = set().union(*map(toxicity.features, pool))
    for _ in range(200):
        w = set(rng.sample(pool, rng.randint(1, 6)))
        want = []
        for g, group in enumerate(toxicity.IDENTITY_TERMS):
            for a in group:
                for b in group:
                    if a in w and a != b:
                        now, then = toxicity.features(" ".join(w)), toxicity.features(" ".join(w - {a} | {b}))
                        want.append((g, sorted((now - then) & known), sorted((then - now) & known)))
        assert list(toxicity.swaps(toxicity.features(" ".join(w)), known)) == want


def test_toxicity_keeps_every_telling_word(spark):
    """200 words that go with the label, with stems about 1,000 features; a rare insult comes last among them."""
    rng = random.Random(17)
    with_label = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(200)]
    rows, labels = [], []
    for i in range(2000):
        bad = i % 3 == 0
        rows.append((i, " ".join([w for w in with_label if rng.random() < (0.5 if bad else 0.1)] + (["nastyface"] if bad and i < 100 else []))))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"nastyface", *with_label} <= set(model.weights) and len(model.weights) > 600


def test_toxicity_fit_is_the_minimum():
    rng = np.random.default_rng(2)
    vocabulary = ["muslim", "christian", "musl*", "chri*", "tree", "bad"]
    rows = [(int(rng.random() < 0.4), [i for i in range(6) if rng.random() < 0.3]) for _ in range(300)]
    m = toxicity.fit(rows, vocabulary)
    x = np.array([[float(i in at) for i in range(6)] + [1.0] for _, at in rows])
    y, w = np.array([r[0] for r in rows]), np.array([m.weights[v] for v in vocabulary] + [m.bias])
    swaps = [(np.array([(v in b) - (v in a) for v in vocabulary] + [0.0]), 4.0 / (len(toxicity.IDENTITY_TERMS[g]) - 1)) for _, at in rows for g, a, b in toxicity.swaps({vocabulary[i] for i in at}, set(vocabulary))]
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + w * ([1.0] * 6 + [1e-6]) + sum(f * d * (d @ w) for d, f in swaps)
    assert swaps and np.abs(gradient).max() < 1e-4


def test_toxicity_against_a_plain_version(spark):
    """Features, swaps and the fit written out on whole texts and dense matrices; odd rows too."""
    rng = random.Random(31)
    calm = "tree river stone cloud meadow bridge garden women men muslim christian old young".split()
    rows = [(i, " ".join([rng.choice(calm) for _ in range(rng.randint(4, 12))] + (["nastyface"] if i % 3 == 0 and rng.random() < 0.8 else []))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "ÜBER 12 _x_"), (7, rows[7][1])]  # a row that repeats
    labels = [(i, int(i % 3 == 0)) for i in range(400)] + [(9, None), (None, 1)]
    df = spark.createDataFrame([(i, t, 0.5, 3) for i, t in rows], "doc_id long, text string, score double, y int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    stems = lambda t: {f for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]}
    train = [(t, y) for i, t in rows for j, y in labels if i == j and y is not None and zlib.crc32(str(i).encode()) % 5]
    n1, n0 = sum(y for _, y in train), sum(1 - y for _, y in train)
    seen, toxic = Counter(f for t, _ in train for f in stems(t)), Counter(f for t, y in train if y for f in stems(t))
    terms = {x for g in toxicity.IDENTITY_TERMS for x in g}

    def telling(f):
        share = seen[f] / (n1 + n0)
        z = (toxic[f] / n1 - (seen[f] - toxic[f]) / n0) / (share * (1 - share + 1e-9) * (1 / n1 + 1 / n0)) ** 0.5
        return seen[f] >= 5 and abs(z) >= 3.5 or f in terms

    known = sorted(f for f in seen if telling(f))
    assert set(model.weights) == set(known)
    vec = lambda fs: np.array([float(f in fs) for f in known] + [1.0])
    x, y = np.array([vec(stems(t)) for t, _ in train]), np.array([y for _, y in train])
    moves = []
    for t, _ in train:
        w = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        for g in toxicity.IDENTITY_TERMS:
            for a in set(g) & w:
                for b in set(g) - {a}:
                    moves.append((vec(stems(" ".join(w - {a} | {b}))) - vec(stems(" ".join(w)))) * (4.0 / (len(g) - 1)) ** 0.5)
    ridge = np.diag([1.0] * len(known) + [1e-6]) + np.array(moves).T @ np.array(moves)
    v = np.zeros(len(known) + 1)
    for _ in range(60):  # Newton
        p = 1 / (1 + np.exp(-x @ v))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ v)
        v -= step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    got = toxicity.score(df, model).collect()
    assert sorted((r.doc_id for r in got)) == sorted(i for i, _ in rows)
    text = dict(rows)
    for r in got:
        want = 1 / (1 + np.exp(-vec(stems(text[r.doc_id])) @ v))
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.5)
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.train(df.limit(0), lab).weights == {}


def test_language_id_against_a_plain_version(spark):
    """Sequences counted one by one, machines fitted by plain descent in double precision; votes and families written out."""
    rng = random.Random(41)
    words = {"en": "the and that with from this have", "de": "der und nicht eine mit auch sch", "nl": "het een niet van zijn ook dat", "fr": "les des que une dans pour est"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(2, 20))) + rng.choice(["", " 12, x!"]), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(240))]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (3, rows[3][1], rows[3][2]), (None, "der und", "de")]
    df = spark.createDataFrame([(*r, 1.0, "z") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.train(df, per_lang=1000)
    u = lambda v: v & 0xFFFFFFFF

    def plain(text):
        run, last = [], False
        for ch in (text or "").lower():
            if ch.isalpha():
                run.append(ord(ch))
            elif last:
                run.append(32)
            last = ch.isalpha()
        if not any(c != 32 for c in run):
            return None
        run = [32, *run, 32]
        hashes = [u(c * 0x9E3779B1) for c in run if c != 32]
        pairs = []
        for a, b in zip(run, run[1:], strict=False):
            two = u(b * 0x85EBCA77)
            pairs.append(u(a * 0x9E3779B1) ^ u(two << 5 | two >> 27))
        hashes += pairs + [u(p * 0xC2B2AE3D) ^ u(c * 0x9E3779B1) for p, c in zip(pairs, run[2:], strict=False)]
        n = np.zeros(language_id.DIM)
        for h in hashes:
            n[u((h ^ h >> 15) * 0x2C1B3C6D) >> 19] += 1
        return np.sqrt(n) / np.sqrt(n.sum())

    def machine(x, y):
        x = np.hstack((x, np.ones((len(x), 1))))
        c = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)
        step = 1 / (1 + 2 * np.linalg.eigvalsh(x @ x.T * np.sqrt(np.outer(c, c)))[-1])
        w = np.zeros(x.shape[1])
        for _ in range(4000):
            w -= step * (w - 2 * x.T @ (c * y * np.maximum(0, 1 - y * (x @ w))))
        return w

    train = [(plain(t), k) for i, t, k in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 and plain(t) is not None]
    x, y = np.array([t for t, _ in train]), np.array([k for _, k in train])
    family = machine(x, np.where(y == "fr", -1, 1))  # of the two families
    pairs = {(a, b): machine(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1)) for a, b in (("de", "en"), ("de", "nl"), ("en", "nl"))}

    def predict(t):
        f = plain(t)
        if f is None:
            return "und"
        f = np.append(f, 1)
        if f @ family < 0:
            return "fr"
        margin = {p: f @ w for p, w in pairs.items()}
        votes = {g: (sum((v >= 0) == (p[0] == g) for p, v in margin.items() if g in p), sum(v if p[0] == g else -v for p, v in margin.items() if g in p), g) for g in ("de", "en", "nl")}
        return max(votes, key=votes.get)

    text = {i: t for i, t, _ in rows}
    got = language_id.identify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred != predict(text[r.doc_id]) for r in got) <= 2  # margins next to nought
    assert language_id.identify(df.limit(0), model).count() == 0


def test_language_id_votes_that_tie():
    """Three languages that beat each other in a circle: the sum of margins decides, then the name."""
    m = object.__new__(language_id.Model)
    m.langs = ["de", "en", "nl"]
    m.groups, m.families, m.pairs = {"germanic": m.langs}, ["germanic"], {("de", "en"): 0, ("de", "nl"): 1, ("en", "nl"): 2}
    m.weights = np.zeros((2, 3), np.float32)
    m.weights[0] = [1.0, -2.0, 0.5]  # de over en, nl over de, en over nl
    assert m.predict(np.ones(1, np.float32))[0] == "nl"
    m.weights[0] = [1.0, -1.0, 1.0]
    assert m.predict(np.ones(1, np.float32))[0] == "nl"


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", common.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_word_hashes_in_segments():
    t = ["a bb  ccc", "", "dddd " * 50, "é ß"]
    a, n = common.word_hashes(t)
    b, m = common.word_hashes(t, segment=16)
    assert (a == b).all() and (n == m).all() and n.tolist() == [0, 3, 3, 53, 55]
    assert len({int(x) for x in a}) == 6


def brute_cut(rows, length, min_words):
    """Texts without the repeated stretches of ``length`` bytes and more that hold ``min_words`` words."""
    data = [t.encode() for _, t in rows]
    n = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        spans = [(lo, hi) for lo, hi in zip(edge[::2], edge[1::2], strict=True) if len(WORD.findall(b[lo:hi].decode("utf-8", "replace"))) >= min_words]
        out.append((i, suffix_dedup._cut(b, spans).decode("utf-8", "ignore")))
    return out


def pipeline_rows(rng, n=50):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda k: [word() for _ in range(k)]
    passages = [prose(k) for k in (51, 52, 60, 70)]
    short = prose(40)  # a common passage that is not long enough
    rows = []
    for i in range(n):
        w = prose(rng.randint(70, 120))
        if i % 3 == 0:
            w[20:20] = rng.choice(passages)
        if i % 5 == 0:
            w[60:60] = short
        rows.append((i, " ".join(w)))
        if i % 6 == 0:
            rows.append((100 + i, rows[-1][1]))
        if i % 7 == 0:
            near = list(w)
            near[3] = word()
            rows.append((200 + i, " ".join(near)))
        if i % 8 == 0:
            rows.append((300 + i, " ".join(w[:20]) + " # # # # # # # # # # # # # # # # # #"))
    return passages, short, [*rows, (400, None), (401, ""), (402, "too short"), (5, rows[-1][1])]


def brute_pipeline(rows):
    good = [(i, t) for i, t in rows for m in [measures(t)] if m[0] >= 50 and 100 * m[4] <= 50 * m[0] and 10 * m[2] <= m[0]]
    best = {}
    for i, t in good:
        best[t] = max(best.get(t, i), i)
    one = [(i, t) for t, i in best.items()]
    groups = brute_groups(one)
    left = brute_cut([(i, t) for i, t in one if groups[i][0] == i], 200, 51)
    tok = encoder(tokenizer_path("byte_bpe_50k.json"))
    pieces = []
    for i, t in left:
        ids = tok.whole(t) + b"\0" * 4
        n, p, k = len(ids) // 4, 0, 0
        while p < n:
            size = (n % 2048 or 2048) if p == 0 else 2048
            pieces.append((i, k, p, size, zlib.crc32(ids[4 * p : 4 * (p + size)])))
            p, k = p + size, k + 1
    return left, sorted(pieces)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    passages, short, rows = pipeline_rows(random.Random(21))
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == df.columns, name
            docs.write.parquet(str(tmp_path / f"s{k}"))
            docs = spark.read.parquet(str(tmp_path / f"s{k}"))
            assert 0 < docs.count() <= before.count()
    left, pieces = brute_pipeline(rows)
    texts = {r.doc_id: (r.text, r.n_chars) for r in before.collect()}
    assert texts == {i: (t, len(t)) for i, t in left}
    assert not any(" ".join(p) in t for p in passages for t, _ in texts.values()) and sum(" ".join(short) in t for t, _ in texts.values()) > 3
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == pieces
    used = defaultdict(list)
    for r in whole:
        used[r.sequence_id].append((r.offset, r.length))
    for b in used.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
