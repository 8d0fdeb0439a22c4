"""Queries over whole tables, where a part of the rows would give other results, against plain versions."""

import datetime
import math
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestar import queries as core
from lodestar.functions import dictionaries as D
from lodestar.functions import text as T
from lodestar.operators import graph
from lodestar.plans import corpus


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders as (o_orderkey, o_custkey): the number of an order is the key % 997 + 1, and it replaces custkey % 89 + 1."""
    rows = [(8 * i + (7 if i % 2 else 0), (5 * i) % 40, datetime.date(1992 + i % 7, 1 + i % 12, 1 + i % 28), "1-URGENT") for i in range(1, 60)]
    rows += [(k, k, datetime.date(1995, 1, 1), "2-HIGH") for k in (9, 18, 27, 36, 45, 54)]  # the other kinds
    path = tmp_path_factory.mktemp("orders")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path), rows


def replaced(rows):
    return {c % 89 + 1 for k, c, *_ in rows if k % 8 in (0, 7)}


def test_order_status_counts_every_supersession(spark, orders):
    path, rows = orders
    want = {}
    for k, _, day, _ in rows:
        if k % 8 in (0, 7):
            s = "superseded" if k % 997 + 1 in replaced(rows) else "active" if k % 8 == 7 else "likely_superseded" if 2026 - day.year - 20 > 10 else "active"
            want[s] = want.get(s, 0) + 1
    got = {r.status: r.n for r in core.queries()["a11_order_status"](spark, path).collect()}
    assert got == want and len(got) > 1


def test_current_by_topic_counts_every_supersession(spark, orders):
    path, rows = orders
    current = {k % 997 + 1 for k, *_ in rows if k % 8 in (0, 7)} - replaced(rows)
    want = {t: (max(x for x in current if x % 5 == t), sum(x % 5 == t for x in current)) for t in {x % 5 for x in current}}
    got = {r.topic: (r.current, r.n) for r in core.queries()["g12_current_by_topic"](spark, path).collect()}
    assert got == want and got


def test_idf_keeps_rare_terms(spark, tmp_path):
    texts = ["one two two", "Two three", "", None, "été two"] + ["two common"] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = {}
    for t in texts:
        for w in set(re.findall(r"\w+", (t or "").lower())):
            df[w] = df.get(w, 0) + 1
    want = {w: (n, round(math.log((len(texts) - n + 0.5) / (n + 0.5) + 1), 6)) for w, n in df.items()}
    got = {r.term: (r.df, r.idf) for r in core.queries()["r05_idf"](spark, str(tmp_path)).collect()}
    assert got == want
    assert set(got) >= {"one", "three", "été"}


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    texts = [
        "Is it open?", "Wo liegt Köln, and what is its rule?", "Ist das éit? Yes, that.", "ΑΒΓit it", "日本that is this", "plain", "", None,
        "first part\n\nsecond part\n\n  \n\n third ", "x" * 6000, "\n\n".join(["ä" * 2400, "b" * 2500, "c" * 2600, "d" * 10]), "THIS été it", "a_it it", "line\nthat line",
    ]
    rows = [(i // 7, i % 7, "user" if i % 2 else "bot", t) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path), rows


def test_references_of_every_turn_are_resolved(spark, turns):
    path, rows = turns
    value = {(c, t): f"{role}{t}" if t % 3 == 0 else None for c, t, role, _ in rows}
    want = {}
    for c, t, _, text in rows:
        if text is None:
            continue
        v = next((value[c, k] for k in range(t, max(-1, t - 6), -1) if value[c, k]), None)
        want[c, t] = re.sub(r"\b(?:it|its|that|this)\b", v, text, count=1, flags=re.I) if text and v else text
    got = {(r.conv_id, r.turn): r.resolved for r in core.queries()["n08b_resolve_references"](spark, path).collect()}
    assert got == want
    assert got[0, 2] == "Ist das éit? Yes, bot0."


def test_generic_sections_of_every_text(spark, turns):
    path, rows = turns
    want = {}
    for c, t, _, text in rows:
        out = []
        for p in filter(None, (p.strip(" ") for p in (text or "").split("\n\n"))):
            if out and len(out[-1]) + len(p) <= 5000:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        want |= {(c, t, i): p for i, p in enumerate(out)}
    got = {(r.conv_id, r.turn, r.position): r.text for r in core.queries()["k05_generic_sections"](spark, path).collect()}
    assert got == want
    assert any(i for _, _, i in got) and max(map(len, got.values())) >= 5000


def test_sequence_ratio_of_every_chunk(spark, orders):
    path, rows = orders
    forms = corpus.chunks(spark, path).select("chunk_id", "kind", T.for_comparison(F.col("text")).alias("a"), T.for_comparison(F.col("title")).alias("b")).collect()
    assert {r.kind for r in forms} == set(range(8)) and len(forms) == len(rows)
    got = {r.chunk_id: r.ratio for r in core.queries()["u06_sequence_ratio"](spark, path).collect()}
    assert got == {r.chunk_id: round(SequenceMatcher(None, r.a, r.b).ratio(), 6) for r in forms}


def test_acronyms_of_every_chunk_are_expanded(spark, orders):
    path, rows = orders
    table = D.ACRONYMS
    want = {}
    for r in corpus.chunks(spark, path).collect():
        out = r.text
        for k in sorted(table, key=lambda k: (-len(k), k)):
            out = re.sub(rf"(?i)\b({re.escape(k)})" + (r"\b" if k[-1].isalnum() else ""), rf"\1 ({table[k]})", out)
        want[r.chunk_id] = out
    got = {r.chunk_id: r.out for r in core.queries()["t16_expand_acronyms"](spark, path).collect()}
    assert got == want and len(got) == len(rows)


@pytest.fixture
def few_rows(spark):
    """Spark stops recursive SQL at this number of rows; a million in use, which takes long to pass."""
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, 50)
    yield
    spark.conf.unset(key)


def test_chains_hold_any_number_of_rows(spark, few_rows):
    target = {i: i // 3 for i in range(1, 200) if i % 7} | {300: 301, 301: 302, 302: 300, 400: 400}
    want = set()
    for start in target:
        path = [start]
        while len(path) <= 10 and path[-1] in target and target[path[-1]] not in path:
            path.append(target[path[-1]])
            want.add((start, path[-1], len(path) - 1))
    edges = spark.createDataFrame([(s, t, 0.9) for s, t in target.items()], "source long, target long, confidence double")
    got = [tuple(r) for r in graph.chains(spark, edges).collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == want
    ends = {r.start: (r.current, r.length) for r in graph.chain_ends(spark, edges).collect()}
    assert ends == {s: max(((n, d) for x, n, d in want if x == s), key=lambda p: p[1]) for s in {x for x, _, _ in want}}


def test_closure_holds_any_number_of_rows(spark, few_rows):
    edges = {(i, j): 0.5 + (i * 7 + j) % 11 / 20 for i in range(40) for j in ((i + 1) % 40, (i * 3 + 2) % 40, (i * 5) % 40)}
    step = {(s, t, 1, c * 0.8) for (s, t), c in edges.items() if s != t}
    want = {}
    for _ in range(10):
        for s, t, d, c in sorted(step, key=lambda r: -r[3]):
            if c > 0.3:
                want.setdefault((s, t), (d, round(c, 9)))
        step = {(s, t, d + 1, c * edges[u, t] * 0.8) for s, u, d, c in step for v, t in edges if v == u and t not in (u, s) and c * edges[u, t] * 0.8 > 0.3}
    df = spark.createDataFrame([(*k, c) for k, c in edges.items()], "source long, target long, confidence double")
    got = {(r.source, r.target): (r.depth, round(r.confidence, 9)) for r in graph.closure(spark, df).collect()}
    assert got == want and len(got) > 50


def test_long_chains_and_cycles(spark):
    """A chain of a thousand, walks into cycles of several sizes, random graphs: a walk stops before a node that it has seen."""
    import random

    rng = random.Random(6)
    target = {i: i + 1 for i in range(1000)}  # ends at 1000
    target |= {2000 + i: 2000 + (i + 1) % 7 for i in range(7)} | {2100: 2101, 2101: 2003, 2200: 2201, 2201: 2200, 2300: 2300}
    target |= {3000 + i: 3000 + rng.randrange(300) for i in range(300)}
    want, length = {}, 0
    for start, first in target.items():
        path = [start]
        while target.get(path[-1], path[-1]) not in path:
            path.append(target[path[-1]])
        if first != start:
            want[start] = (path[-1], len(path) - 1)
            length += len(path) - 1
    edges = spark.createDataFrame([(s, t, 0.9) for s, t in target.items()] + [(5, 900, 0.9)], "source long, target long, confidence double")
    assert {r.start: (r.current, r.length) for r in graph.chain_ends(spark, edges).collect()} == want
    assert want[0] == (1000, 1000) and graph.chains(spark, edges).count() == length
    sides = {r.node: (r.oldest, r.n_older, r.newest, r.n_newer) for r in graph.chain_sides(spark, edges.where("source < 1000 AND (target <> 900 OR source = 899)")).collect()}
    assert sides[0] == (1000, 1000, 0, 0) and sides[1000] == (1000, 0, 0, 1000) and sides[400] == (1000, 600, 0, 400)
    none = spark.createDataFrame([], "source long, target long, confidence double")
    assert graph.chain_ends(spark, none).count() == graph.chains(spark, none).count() == 0


def test_two_batches_of_edges_are_one(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.randrange(25), rng.randrange(25), rng.choice([0.5, 0.7, 0.9, 1.0, 1.2])) for _ in range(110)]
    df = lambda r: spark.createDataFrame(r, "source long, target long, confidence double")
    plain = lambda d: {(r.source, r.target, r.depth): round(r.confidence, 9) for r in d.collect()}
    whole = plain(graph.walks(spark, df(rows)))
    first = graph.kept(graph.walks(spark, df(rows[:70])), graph.shared_folder(spark, "test"), "first")
    assert plain(graph.extend_walks(spark, first, df(rows[:70]), df(rows[70:]))) == whole and len(whole) > 500
    assert plain(graph.extend_walks(spark, first, df(rows[:70]), df(rows[:20]))) == plain(first)  # nothing new


def test_tasks_on_order_texts_grow_with_the_files(spark, orders, monkeypatch):
    path, rows = orders
    size = corpus.file_bytes(corpus.table(spark, path, "orders"))
    monkeypatch.setattr(corpus, "TASK_BYTES", size // 19)
    c = corpus.chunks(spark, path)
    assert c.rdd.getNumPartitions() >= 19 and c.count() == len(rows)


def test_shingles_are_not_broadcast(spark, orders):
    """A table that looks small by its files is joined by exchanges, the sets being made after them."""
    j = core.queries()["u05_jaccard"](spark, orders[0])
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()


def test_plain_search_before_a_pattern_loses_no_match(spark):
    from lodestar.functions import classify as C
    from lodestar.functions import extract as E
    from lodestar.operators import evidence as V

    patterns = [p for groups in C.TYPE_PATTERNS.values() for g in groups for p in g] + [p for ps in E.SIMPLE.values() for p in ps] + [p for _, p in V.RELATIONSHIPS] + [r[2] for r in (*V.ENTITIES, *V.RELATIONS, *E.RELATIONS)]
    rows = [r.text for r in corpus.chunks(spark, "/root/testdata/sf0.001").select("text").collect()]
    rows += [t.upper() for t in rows[:200]] + [t.lower() for t in rows[:200]]
    assert sum(bool(T.needed(p)) for p in patterns) > len(patterns) * 0.7
    for p in patterns:
        for t in rows:
            if T.needed(p) and not any(x in t.lower() for x in T.needed(p)):
                assert not re.search(p, t), (p, t)
    assert T.needed(r"(?i)\\b(?:crores?|lakhs?)\\b".replace("\\\\", "\\")) == ("crore", "lakh") and T.needed(r"\d+") == ()


def test_a_query_is_expanded_and_routed_inside_its_row(spark):
    """No task holds more than a row, however many queries there are."""
    from lodestar.operators import understanding as N

    q = spark.createDataFrame([(1, "Teacher rules and teacher salary"), (2, None), (3, "")], "id long, q string")
    e = N.expansions(q, "id", "q")
    r = N.route(q.select("id", "q", F.lit("data_query").alias("i"), F.lit("simple").alias("c"), F.array(F.lit("Data_Reports")).alias("v")), "id", "q", "i", "c", "v")
    for df in (e, r):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    own = [x for x in e.collect() if x.id == 1]
    assert own[0].kind == "original" and [x.rank for x in own] == list(range(1, len(own) + 1)) and len({x.text for x in own}) == len(own) <= 5
    assert [(x.rank) for x in r.where("id = 1").collect()] == [1, 2]


def test_pointers_to_one_end_do_not_meet_in_one_task(spark, monkeypatch):
    """F15 to F18: chains that all lead to one node, by the joins of hot keys: the same rows, and no task holds most of them."""
    monkeypatch.setattr(graph, "HOT_ROWS", 20)
    target = {i: i // 3 for i in range(1, 2000)} | {5000: 5001, 5001: 5002, 5002: 5001} | {5100 + i: 5000 for i in range(300)}
    want = set()
    for start in target:
        path = [start]
        while target.get(path[-1], path[-1]) not in path:
            path.append(target[path[-1]])
            want.add((start, path[-1], len(path) - 1))
    edges = spark.createDataFrame(list(target.items()), "source long, target long")
    assert {tuple(r) for r in graph.chains(spark, edges).collect()} == want
    assert {tuple(r) for r in graph.chain_ends(spark, edges).collect()} == {max((w for w in want if w[0] == s), key=lambda w: w[2]) for s in {w[0] for w in want}}
    n = iter(range(100))
    keep = lambda df: graph.kept(df, folder, str(next(n)))
    folder = graph.shared_folder(spark, "test")
    rows = graph.kept(spark.range(2000).selectExpr("id AS node", "IF(id < 1800, 7, id) AS to").repartition(8), folder, "rows")
    on = spark.range(0, 2000, 2).selectExpr("id AS to", "id + 1 AS value").unionByName(spark.sql("SELECT 7L AS to, 8L AS value"))
    several = on.unionByName(on.selectExpr("to", "-value AS value"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, times in ((graph.met(rows, on, "to", 2000, keep), 1), (graph.met_by_many(rows, several, "to", 2000, keep), 2)):
            got = got.selectExpr("*", "spark_partition_id() AS task").collect()
            assert sorted((r.node, r.value) for r in got if r.to == 7) == sorted((i, v) for i in range(1800) for v in (8, -8)[:times])
            assert {(r.to, r.value) for r in got if r.to != 7 and (r.value or 0) > 0} == {(i, i + 1) for i in range(1800, 2000, 2)}
            tasks = [r.task for r in got]
            assert max(tasks.count(t) for t in set(tasks)) < len(got) // 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_data_chunks_stay_in_their_row(spark):
    """sentences are those of the patterns, runs of lines those of a plain loop, and nothing moves."""
    import random

    from lodestar.operators import chunking

    rng = random.Random(7)
    part = ["total", "Average", "subtotal", "held", "Ruled", "x", "12 7", " ", "\n", "\n", ".", "!", "?", "é", "3", "shows"]
    texts = ["", "\n", "1 2", "total", "total. Average", *("".join(rng.choice(part) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(300))]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "id int, text string").coalesce(1)
    found = df.select("text", *[chunking.sentences(F.col("text"), p).alias(n) for n, p in (("s", chunking.SUMMARY), ("h", chunking.HOLDING))])
    pattern = df.select("text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("s", chunking.SUMMARY), ("h", chunking.HOLDING))])
    assert found.collect() == pattern.collect()
    want = set()
    for i, text in enumerate(texts):
        runs, last = [], None
        for no, line in enumerate(text.split("\n")):
            if re.search(r"[0-9].*\s.*[0-9]", line):
                if last != no - 1:
                    runs.append([])
                runs[-1].append(line)
                last = no
        want |= {(i, "data_table", k, f"Table {k}:\n" + "\n".join(r)) for k, r in enumerate(runs, 1)}
    out = chunking.data_chunks(df, "id", "text")
    assert {tuple(r) for r in out.where("chunk_type = 'data_table'").collect()} == want and len(want) > 100
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_document_sort_their_shingles_together(spark, monkeypatch):
    """short, empty and equal texts, equal positions, groups larger than a slice; the shingles of a text are made once."""
    import random

    from lodestar.operators import set_join

    monkeypatch.setattr(set_join, "SLICE_BITS", 4)
    monkeypatch.setattr(set_join, "SLICE_CHARS", 300)
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ab .") for _ in range(rng.choice((0, 2, 4, 5, 6, 40))))
    rows = [(g, 1000 * g + i, rng.randrange(-2, 6), text()) for g in range(-9, 40) for i in range(50 if g == 7 else rng.randrange(1, 6))] + [(None, 5, 1, "ab"), (3, 6, None, "ab")]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} or {t} for *_, t in rows]
    want = {(a[1], b[1], len(x & y), len(x | y)) for a, x in zip(rows, sets) for b, y in zip(rows, sets) if None not in (a[0], a[2], b[2]) and a[0] == b[0] and a[2] < b[2]}
    df = spark.createDataFrame(rows, "group long, id long, pos int, norm string").repartition(3, "group").sortWithinPartitions("group")
    for n in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            got = [tuple(r) for r in set_join.pairs_in_groups(df).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) > 1000 and set(got) == want
    assert core.queries()["u05_jaccard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
