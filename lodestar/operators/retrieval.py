"""Ranked retrieval: vectors, BM25, fusion, boosts, diversity, context budget, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

K1, B, RRF = 1.5, 0.75, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", floor: float | None = None) -> DataFrame:
    """The ``k`` most similar rows: exact, by a sorted limit in every partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", cosine(F.col(vector_col), q))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def top_per_group(scored: DataFrame, group: str, k: int, score_col: str, id_col: str) -> DataFrame:
    """The k best of each group; the optimizer limits every partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score_col), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def idf(docs: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """(term, df, idf, n_docs, avg_length); with ``terms`` only those."""
    w = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    stats = w.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_length"))
    kept = F.array_intersect("w", F.array(*[F.lit(t) for t in terms])) if terms else F.array_distinct("w")
    df = w.select(F.explode(kept).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))  # stats is one row


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the documents with a positive score; a repeated query term counts again."""
    import regex

    asked = regex.findall(r"[\p{L}\p{N}_]+", query.lower())
    if not asked:
        return docs.select(F.col(id_col)).withColumn("score", F.lit(0.0)).limit(0)
    terms = sorted(set(asked))
    stats = idf(docs, id_col, text_col, terms)
    w = docs.select(F.col(id_col), words(F.col(text_col)).alias("w"))
    # Only the query's terms leave the row: one small row for each document and term that occurs.
    tf = w.select(id_col, F.size("w").alias("len"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter("w", _same(t))).alias("tf")) for t in terms])).alias("t"))
    tf = tf.select(id_col, "len", "t.*").where("tf > 0")
    times = F.create_map(*[F.lit(x) for t in terms for x in (t, asked.count(t))])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_length"))) * F.element_at(times, F.col("term"))
    return tf.join(F.broadcast(stats), "term").groupBy(id_col).agg(F.sum(part).alias("score")).where("score > 0")  # stats: a row per query term


def order_rank(text: Column, similarity: Column, year: Column, as_of: int, terms=(("government order", 0.2), ("g.o.", 0.2), ("circular", 0.1), ("supersession", 0.1), ("supersedes", 0.1))) -> Column:
    """0.7 of the similarity and 0.3 of what speaks of an order: its terms and how recent it is; at most 1."""
    low, age = F.lower(text), as_of - year
    own = sum((F.when(low.contains(k), w).otherwise(0.0) for k, w in terms), F.lit(0.0)) + F.when(age <= 1, 0.15).when(age <= 3, 0.1).when(age <= 5, 0.05).otherwise(0.0)
    return 0.7 * similarity + 0.3 * F.least(F.lit(1.0), own)


AUTHORITY = {"act": 1.0, "rule": 0.9, "government_order": 0.8, "judicial": 0.7}


def cross_validation(df: DataFrame, group: str, text_col: str, type_col: str, relevance: Column) -> DataFrame:
    """(group, calibrated): relevance and authority of its rows, less where some say shall or must and others may or should."""
    t = F.col(text_col)
    authority = F.coalesce(*[F.when(F.col(type_col) == k, F.lit(v)) for k, v in AUTHORITY.items()], F.lit(0.5))
    c = df.groupBy(group).agg(F.avg(authority).alias("authority"), F.avg(relevance).alias("relevance"), F.max(t.rlike("(?i)shall|must").cast("int")).alias("strict"), F.max(t.rlike("(?i)may|should").cast("int")).alias("loose"))
    agree = F.when((F.col("strict") == 1) & (F.col("loose") == 1), 0.5).otherwise(1.0)
    return c.select(group, F.round(0.4 * F.col("relevance") + 0.4 * F.col("authority") + 0.2 * agree, 6).alias("calibrated"))


def merge_results(lists: list[DataFrame], id_col: str) -> DataFrame:
    """Rows of several result lists, of each id the first list's, with ``src`` from 1 on; rows without an id are dropped."""
    both = None
    for i, df in enumerate(lists, 1):
        df = df.where(F.col(id_col).isNotNull()).withColumn("src", F.lit(i))
        both = df if both is None else both.unionByName(df)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col).orderBy("src"))).where("_rn = 1").drop("_rn")


def _same(t: str):
    return lambda x: x == F.lit(t)


def rank_fusion(a: DataFrame, b: DataFrame, id_col: str, weight_a: float = 0.7, weight_b: float = 0.3, k: int = RRF) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists with a ``rank`` column."""
    x = a.select(id_col, (F.lit(weight_a) / (k + F.col("rank"))).alias("a_rrf"))
    y = b.select(id_col, (F.lit(weight_b) / (k + F.col("rank"))).alias("b_rrf"))
    return x.join(y, id_col, "full_outer").withColumn("score", F.coalesce("a_rrf", F.lit(0.0)) + F.coalesce("b_rrf", F.lit(0.0)))


def ranked(df: DataFrame, score_col: str, id_col: str, k: int) -> DataFrame:
    """The k best rows with their rank; the limit comes first, so the ranking window holds k rows."""
    return df.orderBy(F.desc(score_col), id_col).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score_col), id_col)))


def min_max(df: DataFrame, score_col: str) -> DataFrame:
    """Scores scaled to 0..1; all equal: 1."""
    m = df.agg(F.min(score_col).alias("_lo"), F.max(score_col).alias("_hi"))
    return df.crossJoin(F.broadcast(m)).withColumn("normalized", F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score_col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def metadata_boost(year: Column, doc_type: Column, priority: Column) -> Column:
    recent = F.when(year >= 2023, 1.2).when(year >= 2020, 1.1).when(year < 2015, 0.9).otherwise(1.0)
    kind = F.lower(F.coalesce(doc_type, F.lit("")))
    by_type = F.when(kind.isin("act", "rule"), 1.15).when(kind == "government_order", 1.10).when(kind == "framework", 0.95).otherwise(1.0)
    prio = F.lower(F.coalesce(priority, F.lit("")))
    return recent * by_type * F.when(prio == "high", 1.1).when(prio == "low", 0.95).otherwise(1.0)


def recency_boost(year: Column, as_of: int) -> Column:
    age = F.lit(as_of) - year
    return F.when(year.isNull() | (year == 0), 1.0).when(age <= 1, 1.3).when(age <= 3, 1.15).when(age <= 5, 1.05).otherwise(1.0)


def within_age(df: DataFrame, year_col: str, as_of: int, max_age: int) -> DataFrame:
    """Rows not older than ``max_age``; a row without a year stays."""
    y = F.col(year_col)
    return df.where(y.isNull() | (y == 0) | (as_of - y <= max_age))


def keyword_boost(score: Column, text: Column, keywords: list[str], factor: float = 1.5) -> Column:
    n = sum((F.when(F.lower(text).contains(k), 1).otherwise(0) for k in keywords), F.lit(0))
    return score * (1 + (factor - 1) * n / max(1, len(keywords)))


def metadata_filter(df: DataFrame, filters: dict) -> DataFrame:
    """Equality, lists (any of) and ranges {gte, gt, lte, lt}; a missing value fails."""
    for c, v in filters.items():
        if isinstance(v, dict):
            for op, x in v.items():
                df = df.where({"gte": F.col(c) >= x, "gt": F.col(c) > x, "lte": F.col(c) <= x, "lt": F.col(c) < x}[op])
        else:
            df = df.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def diversify(ranked_rows: DataFrame, group: str, id_col: str, text_col: str, score_col: str, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over the candidates of each query: greedy, so a grouped pandas function.

    Candidates are a top-n list, bounded by the caller. The first pick keeps its score, later ones get
    weight * score - (1 - weight) * greatest word Jaccard to the picks before.
    """
    schema = f"{group} {ranked_rows.schema[group].dataType.simpleString()}, {id_col} long, pick int, mmr double"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score_col, id_col], ascending=[False, True])
        left = [(i, s, frozenset(str(t).lower().split())) for i, s, t in zip(frame[id_col], frame[score_col], frame[text_col], strict=True)]
        picks: list = []
        while left and len(picks) < k:
            if not picks:
                best, value = left[0], left[0][1]
            else:
                worth = [weight * s - (1 - weight) * max(len(w & p[2]) / len(w | p[2]) if w | p[2] else 0.0 for p, _ in picks) for _, s, w in left]
                at = max(range(len(left)), key=lambda n: (round(worth[n], 12), -n))
                best, value = left[at], worth[at]
            left.remove(best)
            picks.append((best, value))
        return pd.DataFrame({group: [frame[group].iloc[0]] * len(picks), id_col: [p[0] for p, _ in picks], "pick": range(1, len(picks) + 1), "mmr": [round(float(v), 6) for _, v in picks]})

    return ranked_rows.select(group, F.col(id_col).cast("long").alias(id_col), text_col, score_col).groupBy(group).applyInPandas(one, schema)


def within_budget(rows: DataFrame, group: str, order: str, text_col: str, max_rows: int, max_tokens: int) -> DataFrame:
    """The first rows of each group whose estimated tokens (a quarter of the characters) stay within the budget; stops at the first that does not."""
    w = Window.partitionBy(group).orderBy(order)
    t = rows.withColumn("tokens", F.floor(F.length(F.coalesce(F.col(text_col), F.lit(""))) / 4)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_rows)
    running = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.withColumn("total", running).where(F.col("total") <= max_tokens)


CITATION = r"\[Source (\d+)\]"


def citation_check(answer: Column, n_sources: Column) -> dict[str, Column]:
    found = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))
    valid = F.array_distinct(F.filter(found, lambda x: x.between(1, n_sources)))
    wrong = F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.between(1, n_sources))))
    n_words = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    return {
        "total_citations": F.size(found),
        "unique_sources_cited": F.size(valid),
        "invalid_citations": wrong,
        "all_citations_valid": F.size(wrong) == 0,
        "citation_density": F.size(found) / F.greatest(n_words, F.lit(1)),
        "sources_used_percentage": F.when(n_sources > 0, F.size(valid) / n_sources * 100).otherwise(0.0),
    }


def answer_confidence(top_score: Column, all_valid: Column, cited: Column, n_chunks: Column) -> Column:
    coverage = F.least(cited / F.greatest(n_chunks, F.lit(1)) * 3, F.lit(1.0))
    return F.round(top_score * 0.5 + F.when(all_valid, 1.0).otherwise(0.7) * 0.3 + coverage * 0.2, 2)


def source_confidence(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n <= 2, 0.5).when(n <= 4, 0.7).otherwise(0.9)


def precision_recall(found: DataFrame, relevant: DataFrame, group: str, id_col: str) -> DataFrame:
    f, r = found.select(group, id_col).distinct(), relevant.select(group, id_col).distinct()
    hit = f.join(r, [group, id_col], "left_semi").groupBy(group).agg(F.count("*").alias("hits"))
    n_f, n_r = f.groupBy(group).agg(F.count("*").alias("n_found")), r.groupBy(group).agg(F.count("*").alias("n_relevant"))
    out = n_f.join(n_r, group, "full_outer").join(hit, group, "left").na.fill(0, ["n_found", "n_relevant", "hits"])
    return out.select(group, F.coalesce(F.try_divide(F.col("hits"), F.col("n_found")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("hits"), F.col("n_relevant")), F.lit(0.0)).alias("recall"))
