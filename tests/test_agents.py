"""Reranking, topic tables, spans and the postings index against plain versions."""

import re

from pyspark.sql import functions as F

from lodestar.functions import dictionaries as D
from lodestar.functions import extract as E
from lodestar.operators import agents, evidence, retrieval


def test_spans_are_those_of_the_text(spark):
    texts = ["", None, "Section 5", "a Section 12(a) b  section 3, Sec. 4\nSection 5é", "Section 1Section 2", "no match", "  GO MS No. 7 and G.O.Ms.No. 8 dated 1.2.2020"]
    rules = [("section", 0.9, r"(?i)\bsection\s+(\d+)", 1), ("order", 0.5, r"(?i)G\.?O\.?\s*Ms\.?\s*No\.?\s*(\d+)", 0)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.kind, r.value, r.start, r.end, r.context) for r in evidence.found(df, "id", "text", rules, 4).collect())
    want = sorted((i, k, m[g].strip(), m.start(), m.end(), (t[max(0, m.start() - 4) : m.end() + 4]).strip()) for i, t in enumerate(texts) for k, _, p, g in rules for m in re.finditer(p, t or ""))
    assert got == want and len(got) > 5
    assert evidence.found(df.limit(0), "id", "text", rules).count() == 0


def test_every_dictionary_entry_is_found(spark):
    kinds = {"schemes": D.SCHEMES, "districts": D.DISTRICTS, "social_categories": D.SOCIAL_CATEGORIES, "school_types": D.SCHOOL_TYPES, "education_levels": D.EDUCATION_LEVELS}
    for kind, names in kinds.items():
        df = spark.createDataFrame([(n, f"In {n.upper()}, and so on") for n in names], "name string, text string")
        for r in df.select("name", E.matches(F.col("text"), E.SIMPLE[kind]).alias("m")).collect():
            # The first entry of the list that the name begins with, as whole words.
            want = next(x for x in names if re.match(re.escape(x.lower()) + r"(?!\w)", r.name.lower()))
            assert r.m and r.m[0].lower() == want.lower()


def test_rerank_is_greedy_and_diverse(spark):
    rows = [(1, i, " ".join(f"w{(i * k) % 7}" for k in range(1, 6)), (i * 37 % 11) / 11) for i in range(20)] + [(2, 50, None, 0.5)]
    df = spark.createDataFrame(rows, "q int, id long, text string, score double")
    got = [(r.id, r.mmr) for r in agents.rerank(df, "q", "id", "text", F.col("score"), F.when(F.col("id") < 5, 1.2).otherwise(1.0), 6, 0.3, 12).where("q = 1").orderBy("pick").collect()]
    left = sorted(((s * (1.2 if i < 5 else 1.0), i, set(t.split())) for q, i, t, s in rows if q == 1), key=lambda r: (-r[0], r[1]))[:12]
    picks = [left.pop(0)]
    want = [(picks[0][1], round(picks[0][0], 6))]
    while len(picks) < 6:
        worth = lambda r: 0.7 * r[0] - 0.3 * max(len(r[2] & p[2]) / len(r[2] | p[2]) for p in picks)
        best = max(left, key=lambda r: (round(worth(r), 12), -left.index(r)))
        want.append((best[1], round(worth(best), 6)))
        left.remove(best)
        picks.append(best)
    assert got == want


def test_topic_table_scores_inside_the_row(spark):
    a = "array<string>"
    topics = spark.createDataFrame([("x", "X", ["two words", "three"], ["amma vodi"], [], ["guntur"], [r"\\b\\d+:\\d+\\b".replace("\\\\", "\\")], ["y"]), ("y", "Y", ["none"], [], ["ptr"], [], [], [])], f"topic string, name string, keywords {a}, schemes {a}, metrics {a}, districts {a}, patterns {a}, related {a}")
    df = spark.createDataFrame([(1, "Two words and three"), (2, "two only in GUNTUR at 30:1 or 4:5"), (3, None), (4, "PTR and Amma Vodi")], "id int, text string")
    got = {(r.id, r.topic): r.score for r in agents.topic_scores(df, "id", "text", topics).collect()}
    assert got == {(1, "x"): 4.0, (2, "x"): round(0.5 + 1.5 * 1.2 + 3.0 * 1.3, 6), (4, "x"): round(3 * 1.2, 6), (4, "y"): round(2 * 1.2, 6)}
    best = {(r.id, r.topic): (r.level, r.rank) for r in agents.best_topics(agents.topic_scores(df, "id", "text", topics), "id").collect()}
    assert best[4, "x"] == ("high", 1) and best[4, "y"] == ("medium", 2)
    assert {(r.topic, r.related) for r in agents.related_topics(topics, topics.select("topic")).collect()} == {("x", "y")}
    assert [r.topic for r in agents.topics_by_keyword(topics, "WORD").collect()] == ["x"] and [r.topic for r in agents.topics_by_entity(topics, "PTR", "metric").collect()] == ["y"]
