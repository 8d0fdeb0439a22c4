"""Names with errors and names in texts against versions that try everything."""

import random
import re

import pytest

from lodestar.functions import dictionaries as D
from lodestar.operators import gazetteer, validate

SYLLABLES = "ka ra vi ma no pur nag dal shi ko ter an gu".split()


def plain_ratio(a, b):
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return int(200 * row[-1] / (len(a) + len(b)) + 0.5)


def test_common_letters():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert validate.ratio(a, b) == plain_ratio(a, b)
    assert validate.token_set_ratio("vodi amma", "amma vodi scheme") == 100
    assert validate.token_set_ratio("one two", "three four") < 60


def wrong(name, rng):
    for kind in rng.sample(["lose", "swap", "add"], rng.randrange(1, 4)):
        i = rng.randrange(len(name))
        name = name[:i] + ("" if kind == "lose" else rng.choice("abcxyz")) + name[i + (kind != "add") :]
    return name


def test_closest_names(spark):
    rng = random.Random(9)
    entries = sorted({" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 6))).title() for _ in range(rng.randrange(1, 3))) for _ in range(900)})
    dictionary = [("district", n) for n in entries] + [("scheme", n) for n in (*D.SCHEMES, *D.GAZETTEER["schemes"])]
    asked = [(k, wrong(n, rng)) for k, n in dictionary] + [("district", ""), ("district", "Zzzzz"), ("scheme", "Vodi Amma"), ("other", "Guntur")]
    got = {(r.kind, r.name): (r.match, r.score) for r in validate.closest(spark.createDataFrame(asked + asked[:50], "kind string, name string"), spark.createDataFrame(dictionary, "kind string, name string")).collect()}
    want = {}
    for k, n in asked:
        near = [(-(validate.token_set_ratio if k == "scheme" else plain_ratio)(validate.form(n), validate.form(e)), e) for kind, e in dictionary if kind == k]
        if near and -min(near)[0] >= 80:
            want[k, n] = (min(near)[1], -min(near)[0])
    assert len(want) > 600
    assert got == want


def test_validation(spark):
    d = spark.createDataFrame([("district", "Guntur"), ("district", "Nellore"), ("scheme", "Amma Vodi"), ("metric", "dropout rate")], "kind string, name string")
    q = spark.createDataFrame([(1, "Schools of GUNTUR"), (2, None), (3, "fine in Nellore")], "qid int, text string")
    e = [(1, "district", "Gunturr"), (1, "district", "Nellore"), (1, "district", "Atlantis"), (1, "district", "Guntur"), (1, "date", "2031-32"), (2, "date", "soon"), (2, "date", "2012-13"), (2, "scheme", "Dragons"), (2, "metric", "dragons"), (2, "metric", "dropout rates"), (3, "district", "Nellore")]
    issues = validate.validate(spark.createDataFrame(e, "qid int, kind string, value string"), q, d)
    got = sorted((r.qid, r.issue, r.value, r.severity, r.suggestion) for r in issues.collect())
    assert got == sorted([
        (1, "typo_corrected", "Gunturr", "info", "Guntur"), (1, "invalid_entity", "Atlantis", "error", None), (1, "out_of_range", "2031-32", "warning", "2010-2025"),
        (1, "possible_hallucination", "Nellore", "warning", None), (1, "possible_hallucination", "Atlantis", "warning", None), (1, "excessive_entities", "4", "warning", None),
        (2, "invalid_format", "soon", "error", None), (2, "invalid_entity", "Dragons", "warning", None), (2, "typo_corrected", "dropout rates", "info", "dropout rate"),
    ])
    assert {r.qid: (r.is_valid, r.n_errors, r.n_corrections) for r in validate.validity(issues, q).collect()} == {1: (False, 1, 1), 2: (False, 1, 1), 3: (True, 0, 0)}


@pytest.mark.parametrize("bits", [1 << 25, 64])  # a full filter changes nothing
def test_names_in_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(gazetteer, "FILTER_BITS", bits)
    rng = random.Random(4)
    vocabulary = "amma vodi scheme \u00e9cole west godavari nadu school of the board".split()
    names = [("scheme", "Amma Vodi", None, 0.95), ("scheme", "amma-vodi Scheme", None, 0.95), ("scheme", "AV school", "Amma Vodi", 0.85), ("scheme", "vodi school", "Amma Vodi", 0.85), ("district", "West  Godavari", None, 0.8), ("district", "godavari \u00c9cole of", "G\u00c9O", 0.85), ("district", "", None, 0.8), ("scheme", "amma vodi", "lesser", 0.85)]
    names += [("many", f"board {i} of", f"c{i}", 0.85) for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "  -", "\n"]) for _ in range(rng.randrange(0, 60))).replace("school", "School") for _ in range(120)] + [None, "", "Board 17 OF boards", "x" * 40 + " amma vodi scheme" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted((r.id, r.kind, r.value, r.confidence, r.word, r.start, r.end, r.context) for r in gazetteer.match_names(docs, spark.createDataFrame(names, "kind string, name string, canonical string, confidence double"), "id", context=True).collect())
    known: dict = {}
    for kind, name, canonical, confidence in names:
        w = tuple(re.findall(r"\w+", name.lower()))
        if w:
            known.setdefault(kind, {}).setdefault(w, []).append((-confidence, canonical or name))
    want = []
    for i, t in enumerate(texts):
        spans = [m.span() for m in re.finditer(r"\w+", t or "")]
        ws = [t[s:e].lower() for s, e in spans]
        for kind, entries in known.items():
            at = 0
            while at < len(ws):
                fit = [n for n in range(min(len(ws) - at, 5), 0, -1) if tuple(ws[at : at + n]) in entries]
                if not fit:
                    at += 1
                    continue
                confidence, value = min(entries[tuple(ws[at : at + fit[0]])])
                s, e = spans[at][0], spans[at + fit[0] - 1][1]
                want.append((i, kind, value, -confidence, at, s, e, t[max(0, s - 50) : e + 50].strip()))
                at += fit[0]
    assert got == sorted(want) and len(want) > 50
    assert gazetteer.match_names(docs.limit(0), spark.createDataFrame(names, "kind string, name string, canonical string, confidence double"), "id").count() == 0


def test_keys_of_names_come_in_bounded_batches_and_many_tasks(spark):
    """long names have a thousand keys each; a task emits them bit by bit, and small names are still dealt into all partitions."""
    rng = random.Random(12)
    names = [("scheme", "".join(rng.choice("abcdefghijklmnop") for _ in range(16))) for _ in range(120)]
    import pyarrow as pa

    batches = list(validate.keyed([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*names, strict=True)], names=["kind", "name"])]))
    assert max(b.num_rows for b in batches) <= validate.ROWS < sum(b.num_rows for b in batches)
    assert {tuple(r.values()) for b in batches for r in b.to_pylist()} == {(k, n, key) for k, n in names for key in validate.keys(n)}
    df = spark.createDataFrame(names[:20], "kind string, name string")
    found = validate.closest(df, df)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert {(r.name, r.match, r.score) for r in found.collect()} == {(n, n, 100) for _, n in names[:20]}
