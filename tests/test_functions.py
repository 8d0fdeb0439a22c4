import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import classify, extract, quality
from lodestar.functions import text as T
from lodestar.operators import dedup, graph, retrieval, sections, set_join, understanding


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "educa-\ntion", T.fix_hyphenation) == "education"
    assert one(spark, "“a” – ‘b’…", T.normalize_unicode) == "\"a\" - 'b'..."
    assert one(spark, "G.O.Ms.No. 5 and go ms no 6", T.standardize_orders) == "GO MS No. 5 and GO MS No. 6"
    assert one(spark, "on 1.2.2020", T.standardize_dates) == "on 1/2/2020"
    assert one(spark, " a  b \n\n\n\n c ", T.normalize_whitespace) == "a b\n\nc"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "government", T.fix_ocr) == "government"
    assert one(spark, "modern", lambda c: T.fix_ocr(c, True)) == "modem"
    assert one(spark, "Rs. 1,234.5 in all", T.first_number) == 1234.5
    assert one(spark, "none", T.first_number) is None
    assert one(spark, "the GOVERMENT Sceme", lambda c: T.spelling(c, {"goverment": "government", "sceme": "scheme"})) == "the GOVERNMENT Scheme"
    assert one(spark, "abc", lambda c: F.size(T.char_shingles(c))) == 1
    assert one(spark, "", lambda c: T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_extract(spark):
    assert one(spark, "15 April 2023", extract.parse_date) == "2023-04-15"
    assert one(spark, "April 5, 2023", extract.parse_date) == "2023-04-05"
    assert one(spark, "2023-1-9", extract.parse_date) == "2023-01-09"
    assert one(spark, "in 2019", extract.parse_date) == "2019-01-01"
    assert one(spark, "15.13.2023", extract.valid_date) is None
    assert one(spark, "nothing", extract.parse_date) is None
    assert sorted(one(spark, "G.O.MS.No. 67/2023, G.O.Ms.No. 45 dated 1.2.2020", extract.order_references)) == ["G.O.MS.No. 45 dated 1.2.2020", "G.O.MS.No. 67/2023"]


def test_classify_and_quality(spark):
    df = spark.createDataFrame([("", "t"), ("Section 1 whereas it is enacted", "The Education Act"), (None, None)], "text string, title string")
    got = [r["predicted_type"] for r in classify.classify(df).collect()]
    assert got == ["unknown", "act", "unknown"]
    assert one(spark, "   ", quality.extraction_score) == 0
    assert one(spark, "a b c d " * 40, quality.extraction_score) == 65
    assert [one(spark, "", lambda c, v=v: quality.level(F.lit(v))) for v in (84.5, 85.0, 69.0, 0.0)] == ["unknown", "excellent", "acceptable", "critical"]
    assert one(spark, "Acts", lambda c: classify.folder_type(F.array(c))) == "act"


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 0.4)], "source long, target long, confidence double")
    got = {(r.source, r.target): (r.depth, round(r.confidence, 4)) for r in graph.closure(spark, edges).collect()}
    assert got[1, 2] == (1, 0.8) and got[1, 3] == (2, 0.64) and (1, 4) not in got and got[3, 4] == (1, 0.32) and (1, 1) not in got
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long")
    assert {(r.start, r.node) for r in graph.chains(spark, chain).collect()} == {(1, 2), (1, 3), (2, 3), (2, 1), (3, 1), (3, 2)}


def test_retrieval(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r.id: r.score for r in retrieval.rank_fusion(a, b, "id").collect()}
    assert max(got, key=got.get) == 2 and set(got) == {1, 2, 3}
    rows = spark.createDataFrame([("q", 1, "a b c", 0.9), ("q", 2, "a b c", 0.89), ("q", 3, "x y z", 0.5)], "q string, id long, text string, score double")
    picks = [r.id for r in retrieval.diversify(rows, "q", "id", "text", "score", 3).orderBy("pick").collect()]
    assert picks[0] == 1 and sorted(picks) == [1, 2, 3]
    turns = spark.createDataFrame([(1, i, "x" * 40) for i in range(5)], "c long, t long, text string")
    kept = retrieval.within_budget(turns, "c", "t", "text", 10, 25).collect()
    assert [r.t for r in kept] == [0, 1]
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in retrieval.vector_search(v, [1.0, 0.0], 5).collect()] == [(2, 1.0), (1, None)]


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\nSection 1 Title\nbody\nSection 2A Other\nmore"), (2, "no headings")], "id long, text string")
    got = [(r.id, r.section_id, r.text) for r in sections.act_sections(df, "id", "text").orderBy("id", "position").collect()]
    assert got == [(1, "sec_1", "body"), (1, "sec_2A", "more"), (2, "full_text", "no headings")]
    parts = spark.createDataFrame([(["aaaa", "bbbb", "cc"],)], "p array<string>").select(sections.pack_parts(F.col("p"), 6, "|").alias("o")).first()["o"]
    assert parts == ["aaaa", "bbbb|cc"]


def test_understanding(spark):
    q = spark.createDataFrame([("What is the PTR in Guntur?",), ("zzz",)], "query string")
    got = understanding.intents(q, "query").collect()
    assert got[0].primary_intent in ("data_query", "factual_lookup", "definition") and got[1].primary_intent == "factual_lookup" and got[1].primary_score == 0.5


def test_dedup(spark):
    d = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today"), (2, "the quick brown fox jumps over the lazy dog todax"), (3, "something else entirely, unrelated"), (4, None)], "id long, text string")
    got = [(r.a, r.b) for r in dedup.near_duplicates(d, "id", "text", 0.85).collect()]
    assert got == [(1, 2)]


def comparison_form(t):
    t = re.sub(r"\s+", " ", (t or "").lower(), flags=re.A)
    return re.sub(r"[^\w\s\-.,;:!?]", "", t, flags=re.A).strip()


def shingle_set(t):
    return {t[i : i + 5] for i in range(max(1, len(t) - 4))}


def like_texts():
    """Texts of a small vocabulary, which share many shingles, and changed copies of some."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdef", k=r.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 90))) for _ in range(250)]
    for i in range(150):
        w = texts[i].split(" ")
        for _ in range(r.randint(0, max(1, len(w) // 8))):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w + r.choices(words, k=r.randint(0, 1 + len(w) // 12))))
    return texts


def most_rows(plan):
    """The most rows that a step of a plan that has run put out."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = plan.children()
    inner += [children.apply(i) for i in range(children.size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_near_duplicates_are_all_pairs(spark, monkeypatch):
    """No pair is lost: not between shards, size classes or blocks, nor at the threshold itself."""
    texts = [*like_texts(), "abcdefghijklmnopqrstu", "abcdefghijklmnopqrstuvwx", "Texts  that\u00e9 differ (only) in form", "texts that differ only in form", "aaaaaa", "aaaaaaaaa", "", None, "abc"]
    forms = {}
    for i, t in enumerate(texts):
        forms.setdefault(comparison_form(t), i)
    sets = [(i, shingle_set(t)) for t, i in forms.items()]
    want = sorted((min(i, j), max(i, j), round(len(a & b) / len(a | b), 6)) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if 100 * len(a & b) >= 85 * len(a | b))
    assert len(want) > 40 and (400, 401, 0.85) in want
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert sorted(map(tuple, dedup.near_duplicates(d, "id", "text", 0.85).collect())) == want
    monkeypatch.setattr(set_join, "SHARD_BYTES", 4096)
    rows = dedup.near_duplicates(d, "id", "text", 0.85)
    assert sorted(map(tuple, rows.collect())) == want


def test_near_duplicates_do_not_meet_on_shingles(spark):
    """Unlike texts with shingles in common send no row for each of them."""
    texts = like_texts()
    rows = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", 0.85)
    assert rows.collect()
    assert most_rows(rows._jdf.queryExecution().executedPlan()) < 10 * len(texts)


def test_near_duplicates_block_by_block():
    """Blocks of any size hold the same pairs, and sketches never differ in more bits than the sets in shingles."""
    sets = sorted((set_join.shingles(comparison_form(t)) for t in like_texts()), key=len)
    words = np.frombuffer(b"".join(set_join._sketch(s, 512) for s in sets), np.uint64).reshape(len(sets), -1)
    k = np.array([len(s) for s in sets])
    for x, y in zip(range(0, 300, 3), range(300, 0, -3), strict=True):
        assert np.bitwise_count(words[x] ^ words[y]).sum() <= len(np.setxor1d(sets[x], sets[y]))

    def pairs(rows, cols):
        set_join.BLOCK_ROWS = rows, cols
        return {(int(a), int(b)) for _, _, x, y in set_join._close(k, words, k, np.ascontiguousarray(words.T), 0.85, True) for a, b in zip(x, y, strict=True)}

    kept = set_join.BLOCK_ROWS
    try:
        assert pairs(*kept) == pairs(3, 5)
    finally:
        set_join.BLOCK_ROWS = kept


def test_comparison_form_is_that_of_the_rules(spark):
    every = "".join(map(chr, range(128))) + "a\u00a0b \u00c9t\u00e9 \u0130 \u2028\u3000 \U0001f600 x & y \x85 "
    want = T.rewrite(F.lower(F.col("x")), T.COMPARE_RULES)
    for t in (every, "  & a  &  b & ", "", "&", "\u00a0 \t"):
        assert one(spark, t, T.for_comparison) == spark.createDataFrame([(t,)], "x string").select(want.alias("y")).first()["y"]


def test_ratio_is_difflib(spark):
    from difflib import SequenceMatcher

    pairs = [("abcd efgh", "abxd efgh"), ("", "x"), ("same", "same"), ("abc", "xyz")]
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").select(dedup.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [round(SequenceMatcher(None, a, b).ratio(), 6) if a and b else 0.0 for a, b in pairs]


def fold(parts, most, glue, overlap):
    out, now = [], None
    for p in parts:
        if now is not None and len(now) + len(p) > most:
            out.append(now)
            now = now[-overlap:] + glue + p if overlap else p
        else:
            now = p if now is None else now + glue + p
    return out + ([now] if now is not None else [])


def test_chunks_are_the_greedy_fold(spark):
    import random

    rng = random.Random(1)
    texts = [(i, "\n\n".join("w" * rng.randint(1, 60) for _ in range(rng.randint(0, 12)))) for i in range(30)]
    got = {}
    for r in sections.general_chunks(spark.createDataFrame(texts, "id long, t string"), "id", "t", 100, 10).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {i: fold(t.split("\n\n"), 100, "\n\n", 10) for i, t in texts if t}


def test_chunk_documents_loses_no_document(spark):
    from lodestar.operators import chunking

    rows = [(1, "Section 1 A\nbody\nSection 2 B\nmore", "act"), (2, "no structure at all", "act"), (3, "line one\nline two", "government_order"), (4, "plain\n\ntext", None), (5, "It was held that the petition of the teachers stands allowed in full. Other.", "judicial")]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "id long, t string, k string"), "id", "t", "k").orderBy("id", "chunk_no").collect()
    assert {r.id for r in got} == {1, 2, 3, 4, 5}
    assert [r.text for r in got if r.id == 1] == ["Section 1 A\nbody", "Section 2 B\nmore"]
    assert [r.chunk_type for r in got if r.id in (2, 4)] == ["general_paragraph", "general_paragraph"]
    assert "judicial_holding" in {r.chunk_type for r in got if r.id == 5}


def test_diversify_is_greedy(spark):
    rows = [("q", i, t, s) for i, (t, s) in enumerate([("a b c d", 1.0), ("a b c e", 0.95), ("x y z", 0.6), ("x y q", 0.55)])]
    got = [r.id for r in retrieval.diversify(spark.createDataFrame(rows, "q string, id long, t string, s double"), "q", "id", "t", "s", 3, 0.5).orderBy("pick").collect()]
    assert got == [0, 2, 1]
