"""The postings index and batch retrieval against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import batch, postings, retrieval
from lodestar.operators.graph import kept
from lodestar.operators.postings import BlockMaxIndex

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["one two two", "Two three \u00e9t\u00e9", "", None, "three three one", "\u00c9T\u00c9 two"] + [f"filler{i % 5} word" for i in range(30)]
    out += [" ".join(rng.choice(WORDS[: rng.choice((5, 60, 400))]) for _ in range(rng.randrange(3, 200))) for _ in range(500)]
    return out + [out[60], out[60]]  # equal texts: ties


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    old = postings.CHUNK_POSTINGS
    postings.CHUNK_POSTINGS = 900
    try:
        return BlockMaxIndex.build(docs, f"file://{tmp_path_factory.mktemp('index')}/i")
    finally:
        postings.CHUNK_POSTINGS = old


def plain_scores(docs, q):
    return {r.doc_id: round(r.score, 9) for r in retrieval.bm25(docs, q).collect()}


def best(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("q", ["two", "two two ONE", "\u00e9t\u00e9 filler3", "w1 w2 w3", "w399 w0", "absent", ""])
def test_search_and_top(docs, index, q):
    want = plain_scores(docs, q)
    assert {r.doc_id: round(r.score, 9) for r in index.search(q).collect()} == pytest.approx(want)
    for k in (1, 7, 1000):
        assert [r.doc_id for r in index.top(q, k).collect()] == [i for i, _ in best(want, k)]


def test_search_reads_the_buckets_and_blocks_that_it_needs(index):
    plan = index.search("two")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    rows, weight = index.needed("w0 w390", 3)
    every = index.postings.where(F.col("term").isin(*weight))
    assert 0 < rows.count() < 0.6 * every.count()
    bounds = index._bounds(every.select("term", "block", "n", "most", "least"), weight)
    best3 = index.search("w0 w390").orderBy(F.desc("score")).limit(3).agg(F.min("score")).first()[0]
    left_out = bounds.join(rows.select("block").distinct(), "block", "left_anti")
    assert left_out.agg(F.max("bound")).first()[0] < best3


def test_bounds_hold_for_every_document(index):
    top = index.postings.select("term", "block", index._impact("most", "least").alias("top"), "ids", "tfs", "lengths")
    e = top.select("top", F.explode(F.arrays_zip("tfs", "lengths")).alias("e")).select("top", F.col("e.tfs").alias("tf"), F.col("e.lengths").alias("length"))
    assert e.where(index._impact() > F.col("top") + 1e-12).count() == 0


def test_empty_collection(docs, tmp_path):
    none = BlockMaxIndex.build(docs.limit(0), f"file://{tmp_path}/none")
    assert none.search("two").count() == 0 and none.top("two", 5).count() == 0


def test_a_rewritten_table_gets_a_new_index(spark, tmp_path):
    path, root = f"file://{tmp_path}/docs", f"file://{tmp_path}/indexes"
    rows = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows("old words").write.parquet(path)
    first = BlockMaxIndex.versioned(spark.read.parquet(path), root)
    again = BlockMaxIndex.versioned(spark.read.parquet(path), root)
    assert again.folder == first.folder and first.search("old").count() == 1
    rows("new words").write.mode("overwrite").parquet(path)
    now = BlockMaxIndex.versioned(spark.read.parquet(path), root)
    assert now.folder != first.folder
    assert now.search("new").count() == 1 and now.search("old").count() == 0
    assert first.search("old").count() == 1  # a reader keeps its own


def test_batch_top_k_is_that_of_single_queries(spark, docs, index, tmp_path):
    asked = ["two ONE", "w1 w2 w3", "w399 w0 w0", "absent", "", None, "filler3 two"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    n = iter(range(99))
    keep = lambda df, name: kept(df, f"file://{tmp_path}", f"{next(n)}")
    got: dict = {}
    for r in index.top_batch(index.query_terms(queries, 10), 5, keep).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    want = {i: [d for d, _ in best(plain_scores(docs, q), 5)] for i, q in enumerate(asked) if q}
    assert got == {i: x for i, x in want.items() if x}


def test_batch_top_k_over_several_shards_moves_no_more_than_k_of_each(spark, docs, index, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_POSTINGS", 2000)
    monkeypatch.setattr(postings, "ASKED", 7)
    asked = ["two ONE", "w1 w2 w3", "w399 w0 w0", "filler3 two", "w0", "w5 w6 w0 w1 w2"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    n = iter(range(99))
    keep = lambda df, name: kept(df, f"file://{tmp_path}", f"{next(n)}")
    found = index.top_batch(index.query_terms(queries, 10), 5, keep)
    got: dict = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    assert got == {i: [d for d, _ in best(plain_scores(docs, q), 5)] for i, q in enumerate(asked)}
    assert next(n) == 1  # the terms are kept, bounds of queries and blocks are not


def test_queries_share_the_search_of_an_expansion(spark, index, tmp_path):
    terms = spark.createDataFrame([(i, "w3", 1, 1.0) for i in range(40)], "qid long, term string, df long, weight double")
    extra = spark.createDataFrame([(i, "w5" if i % 2 else "w6", 0.9, 1) for i in range(40)], "qid long, expansion string, confidence double, no int")
    rows = {}
    n = iter(range(99))

    def keep(df, name):
        out = kept(df, f"file://{tmp_path}", f"{next(n)}")
        rows.setdefault(name, []).append(out.count())
        return out

    found = batch.candidates(index, terms, extra, batch.Plan(), keep)
    assert found.where("src = 1").select("qid").distinct().count() == 40
    assert rows["asked"] == [40, 2]


def test_query_terms_are_the_rarest(spark, index):
    q = spark.createDataFrame([(1, "w0 w0 two filler3 nothere one")], "qid long, text string")
    got = {r.term: r.weight for r in index.query_terms(q, 3).collect()}
    df = {r.term: r.df for r in index.terms.where(F.col("term").isin("w0", "two", "filler3", "one")).collect()}
    assert sorted(got) == sorted(sorted(df, key=lambda t: (df[t], t))[:3])


def test_retrieval_of_a_table_of_queries(spark, docs, texts, index, tmp_path):
    queries = spark.createDataFrame([(1, "w390 w391"), (2, "two"), (3, "nothing"), (4, None)], "qid long, text string")
    edges = spark.createDataFrame([("w390", "w392", 0.9), ("w390", "w391", 0.95), ("w391", "w393", 0.8), ("two", "three", 0.7), ("w391", "w394", 0.75), ("w390", "w395", 0.71)], "source string, target string, confidence double")
    n = iter(range(99))
    keep = lambda df, name: kept(df, f"file://{tmp_path}", f"{next(n)}")
    plan = batch.Plan()
    terms = index.query_terms(queries, plan.max_terms)
    extra = [(r.qid, r.expansion, r.no) for r in batch.expansions(terms, edges, plan).orderBy("qid", "no").collect()]
    assert extra == [(1, "w392", 1), (1, "w393", 2), (1, "w394", 3)]  # not its own term, not at the floor, three at most
    rows = batch.retrieve(index, queries, docs, edges, keep).collect()
    assert {r.qid for r in rows} == {1, 2}
    own = [r for r in rows if r.qid == 1]
    assert len(own) == plan.final and sorted(r.pick for r in own) == list(range(1, 11)) and {r.src for r in own} > {0}
    assert len({(texts[r.doc_id] or "")[:500] for r in own}) == len(own)  # one of equal texts
    for r in own:
        low = (texts[r.doc_id] or "").lower()
        assert r.semantic == pytest.approx(min(1, 0.2 * sum(t in low for t in ("w390", "w391")) + 0.1 * sum(t in low for t in ("w392", "w393", "w394"))))
        assert r.enhanced == pytest.approx(0.5 * r.final + 0.25 * r.semantic + 0.25 * r.relationship, abs=1e-8)
    ranked = [r.enhanced for r in sorted(own, key=lambda r: r.rank)]
    assert ranked == sorted(ranked, reverse=True)
    (c,) = [c for c in batch.confidence(spark.createDataFrame(rows)).collect() if c.qid == 1]
    assert c.n == 10 and 0 < c.confidence <= 1


def test_expansions_build_no_index(spark, docs, index, monkeypatch):
    """frequencies that are counted by themselves are those of the index, which r28_graph_expansions does not build."""
    from lodestar.plans import q_batch

    counted = {(r.term, r.df) for r in postings.document_frequencies(docs).collect()}
    assert counted == {(r.term, r.df) for r in index.terms.collect()} and len(counted) > 100
    monkeypatch.setattr(q_batch, "_index", None)
    assert q_batch.QUERIES["r28_graph_expansions"][0](spark, "/root/testdata/sf0.001").count() > 0


def test_postings_in_chunks_answer_a_table_of_queries(spark, docs, tmp_path, monkeypatch):
    """the postings stay as the tasks wrote them and need less disk than the index; several shards and chunks, frequencies over 255, queries in pieces and together give its rows."""
    many = docs.unionByName(spark.createDataFrame([(100_000, "w0 " * 300 + "w5 rare"), (100_001, "été " * 256 + "w0")], docs.schema))
    for (chunk, shard, passing, at_once, short) in ((postings.CHUNK_POSTINGS, postings.SHARD_POSTINGS, postings.PASSING, postings.AT_ONCE, postings.SHORT), (300, 2000, 2, 40, 30)):
        for name, value in (("SHARD_POSTINGS", shard), ("PASSING", passing), ("AT_ONCE", at_once), ("SHORT", short)):
            monkeypatch.setattr(postings, name, value)
        monkeypatch.setattr(postings, "CHUNK_POSTINGS", chunk)
        monkeypatch.setattr(postings, "FEW_TERMS", 0 if chunk == 300 else 100)
        place = tmp_path / str(chunk)
        c = postings.ChunkedPostings.build(many, f"file://{place}/c")
        i = BlockMaxIndex.build(many, f"file://{place}/i")
        assert (c.n_docs, c.avg_length) == (i.n_docs, i.avg_length)
        assert {tuple(r) for r in c.terms.collect()} == {(r.term, r.df) for r in i.terms.collect()}
        asked = ["two ONE", "w1 w2 w3", "w399 w0 w0", "absent", "", None, "filler3 two", "w0", "w5 w6 w0 w1 w2", "été rare"] * 3
        queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
        n = iter(range(99))
        keep = lambda df, name: kept(df, f"file://{place}", f"{next(n)}")
        rows = lambda x: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 7)) for r in x.top_batch(x.query_terms(queries, 10), 5, keep).collect())
        got = rows(c)
        assert got == rows(i) and len(got) > 60
        unnamed = c.top_batch(c.query_terms(queries.selectExpr("IF(qid = 1, NULL, qid) AS qid", "text"), 10), 5, keep).where("qid IS NULL")
        assert [r.doc_id for r in unnamed.orderBy("rank").collect()] == [d for q, _, d, _ in got if q == 1]
        size = lambda p: sum(f.stat().st_size for f in (place / p).rglob("*.parquet"))
        assert chunk == 300 or size("c") < size("i")


def test_batch_queries_build_no_index(spark, monkeypatch):
    """F1 to F3: the index that is rearranged by term is for single queries."""
    from lodestar.plans import q_batch

    monkeypatch.setattr(BlockMaxIndex, "build", None)
    monkeypatch.setattr(q_batch, "_CHUNKED", {})
    assert q_batch.QUERIES["r08b_batch_top_k"][0](spark, "/root/testdata/sf0.001").count() > 0


def test_words_of_candidates_move_in_turns(spark, tmp_path, monkeypatch):
    """words as numbers or as they are, in one turn or several, give the choice of a plain version."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS[:40]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "Été w1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(q, i, q % 3, rng.randrange(5) / 4, 0.5, 0.25) for q in range(30) for i in rng.sample(range(len(texts)), 12)]
    rows = spark.createDataFrame(found, "qid long, doc_id long, src int, unit double, semantic double, relationship double")
    sets = [set(re.findall(r"\w+", (t or "").lower())) for t in texts]
    want = set()
    for q in range(30):
        left, chosen = sorted((-u, i) for p, i, _, u, *_ in found if p == q), []
        while left and len(chosen) < 10:
            worth = [0.8 * -u - 0.2 * max((len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) or 1) for j in chosen), default=0) for u, i in left]
            at = max(range(len(left)), key=lambda n: (round(worth[n], 12), -n))
            chosen.append(left.pop(at)[1])
            want.add((q, chosen[-1], len(chosen), round(worth[at], 9)))
    terms = docs.selectExpr("explode(regexp_extract_all(lower(text), '\\\\w+', 0)) AS term").groupBy("term").count().withColumnRenamed("count", "df")
    for turn, common in ((batch.TURN_BYTES, batch.COMMON), (1, 15), (2000, 0)):
        monkeypatch.setattr(batch, "TURN_BYTES", turn)
        monkeypatch.setattr(batch, "COMMON", common)
        names = []

        def keep(df, name):
            names.append(name)
            return kept(df, f"file://{tmp_path}", f"{turn}-{len(names)}")

        got = batch._in_turn(rows, docs, terms, batch.Plan(), keep, "doc_id", "text").collect()
        assert {(r.qid, r.doc_id, r.pick, round(r.mmr, 9)) for r in got} == want and len(got) == 300
        assert (names.count("chosen") > 1) == (turn < 10_000)
