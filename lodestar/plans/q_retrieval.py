"""Queries of retrieval, ranking, context and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.postings import BlockMaxIndex, file_state
from ..sources.scratch import shared_folder
from . import corpus
from .duck import lit

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


QUERY_TEXT = "the of and tion"
_TERMS = QUERY_TEXT.split()
QUERY_VECTOR = [((i * 7) % 13 - 6) / 10 for i in range(64)]
_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_COS = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_QV}[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform({_QV}, lambda x: x * x)))"


def _vectors(spark, sf):
    return corpus.table(spark, sf, "embeddings")


def _docs(spark, sf):
    return corpus.table(spark, sf, "documents")


@query("r01_cosine", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings")
def _(spark, sf):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return _vectors(spark, sf).select("vec_id", F.round(R.cosine(F.col("embedding"), q), 6).alias("score"))


@query("r02_vector_top_k", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20")
def _(spark, sf):
    return R.vector_search(_vectors(spark, sf), QUERY_VECTOR, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("r03_multi_collection", f"WITH s AS (SELECT vec_id, label, {_COS} AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT vec_id, label, round(score, 6) AS score FROM r WHERE rank <= 5 AND label IN (0, 1, 2, 3) ORDER BY r.score DESC, vec_id LIMIT 12")
def _(spark, sf):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    s = R.metadata_filter(_vectors(spark, sf), {"label": [0, 1, 2, 3]}).withColumn("score", R.cosine(F.col("embedding"), q))
    return R.top_per_group(s, "label", 5, "score", "vec_id").orderBy(F.desc("score"), "vec_id").limit(12).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("f03_score_threshold", f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} >= 0.1")
def _(spark, sf):
    q = F.array(*[F.lit(x) for x in QUERY_VECTOR])
    return _vectors(spark, sf).withColumn("score", R.cosine(F.col("embedding"), q)).where("score >= 0.1").select("vec_id", F.round("score", 6).alias("score"))


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
_BM = (
    f"w AS (SELECT doc_id, {_TOK} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM w), q AS (SELECT unnest({_TERMS!r}) AS term), "
    "tf AS (SELECT doc_id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1), "
    "bm AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY 1)"
)


_INDEXES: dict = {}


def _index(spark, sf, anew: bool = False) -> BlockMaxIndex:
    """The postings of a table as its files are now, built at the first query of an application and used by the others."""
    docs = _docs(spark, sf)
    key = (spark.sparkContext.applicationId, file_state(docs))
    if anew or key not in _INDEXES:
        _INDEXES[key] = BlockMaxIndex.build(docs, shared_folder(spark, "postings"))
    return _INDEXES[key]


@query("r06_bm25_index", f"WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents) SELECT doc_id, len(list_distinct(w))::BIGINT AS n_terms, len(w)::BIGINT AS length FROM w WHERE len(w) > 0")
def _(spark, sf):
    """Builds the index anew; later queries of the application use this one."""
    i = _index(spark, sf, anew=True)
    return i.entries().groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").cast("long").alias("length"))


@query("r05_idf", f"WITH w AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM w GROUP BY 1) SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d")
def _(spark, sf):
    return R.idf(_docs(spark, sf), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query("r07_bm25", f"WITH {_BM} SELECT doc_id, round(score, 6) AS score FROM bm")
def _(spark, sf):
    return _index(spark, sf).search(QUERY_TEXT).select("doc_id", F.round("score", 6).alias("score"))


@query("r08_bm25_top_k", f"WITH {_BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 25")
def _(spark, sf):
    return _index(spark, sf).top(QUERY_TEXT, 25).select("doc_id", F.round("score", 6).alias("score"))


_V = f"v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings), v20 AS (SELECT * FROM v WHERE rank <= 40)"
_K = "k AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm), k20 AS (SELECT * FROM k WHERE rank <= 40)"
_FUSED = "f AS (SELECT doc_id, coalesce(0.7 / (60 + v20.rank), 0) + coalesce(0.3 / (60 + k20.rank), 0) AS score FROM v20 FULL JOIN k20 USING (doc_id))"


def _lists(spark, sf):
    v = R.vector_search(_vectors(spark, sf), QUERY_VECTOR, 40).select(F.col("vec_id").alias("doc_id"), "score")
    k = _index(spark, sf).top(QUERY_TEXT, 40)
    return R.ranked(v, "score", "doc_id", 40), R.ranked(k, "score", "doc_id", 40)


@query("r09_rank_fusion", f"WITH {_BM}, {_V}, {_K}, {_FUSED} SELECT doc_id, round(score, 9) AS score FROM f")
def _(spark, sf):
    v, k = _lists(spark, sf)
    return R.rank_fusion(v, k, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("r10_hybrid_search", f"WITH {_BM}, {_V}, {_K}, {_FUSED} SELECT doc_id, round(score, 9) AS score FROM f ORDER BY round(f.score, 12) DESC, doc_id LIMIT 20")
def _(spark, sf):
    v, k = _lists(spark, sf)
    f = R.rank_fusion(v, k, "doc_id")
    return f.orderBy(F.desc(F.round("score", 12)), "doc_id").limit(20).select("doc_id", F.round("score", 9).alias("score"))


@query("r11_min_max", f"WITH {_BM} SELECT doc_id, round((score - (SELECT min(score) FROM bm)) / ((SELECT max(score) FROM bm) - (SELECT min(score) FROM bm)), 6) AS normalized FROM bm")
def _(spark, sf):
    return R.min_max(_index(spark, sf).search(QUERY_TEXT), "score").select("doc_id", F.round("normalized", 6).alias("normalized"))


_PRIO = "CASE WHEN prio LIKE '1%' OR prio LIKE '2%' THEN 'high' WHEN prio LIKE '5%' THEN 'low' ELSE 'medium' END"


@query("r12_metadata_boost", f"{corpus.WITH} SELECT chunk_id, round(CASE WHEN y >= 2023 THEN 1.2 WHEN y >= 2020 THEN 1.1 WHEN y < 2015 THEN 0.9 ELSE 1.0 END * CASE WHEN doc_type IN ('act', 'rule') THEN 1.15 WHEN doc_type = 'government_order' THEN 1.1 WHEN doc_type = 'framework' THEN 0.95 ELSE 1.0 END * CASE {_PRIO} WHEN 'high' THEN 1.1 WHEN 'low' THEN 0.95 ELSE 1.0 END, 6) AS boost FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.round(R.metadata_boost(F.col("y"), F.col("doc_type"), F.expr(_PRIO)), 6).alias("boost"))


@query("r13_diversify")
def _(spark, sf):
    c = corpus.chunks(spark, sf).withColumn("score", F.col("v") / 900)
    return R.diversify(R.top_per_group(c, "kind", 30, "score", "chunk_id"), "kind", "chunk_id", "text", "score", 10)


_KW = ["section", "nadu-nedu", "amma vodi", "rte"]


@query("r16_keyword_boost", f"{corpus.WITH} SELECT chunk_id, round(v * (1 + 0.5 * ({' + '.join(f'CASE WHEN contains(lower(text), {lit(k)}) THEN 1 ELSE 0 END' for k in _KW)}) / 4), 6) AS score FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.round(R.keyword_boost(F.col("v"), F.col("text"), _KW), 6).alias("score"))


@query("r18_recency", f"{corpus.WITH} SELECT chunk_id, round(v * CASE WHEN 2018 - y <= 1 THEN 1.3 WHEN 2018 - y <= 3 THEN 1.15 WHEN 2018 - y <= 5 THEN 1.05 ELSE 1.0 END, 6) AS score FROM chunks WHERE 2018 - y <= 4")
def _(spark, sf):
    c = R.within_age(corpus.chunks(spark, sf), "y", 2018, 4)
    return c.select("chunk_id", F.round(F.col("v") * R.recency_boost(F.col("y"), 2018), 6).alias("score"))


@query("f01_metadata_filter", f"{corpus.WITH} SELECT chunk_id FROM chunks WHERE doc_type IN ('act', 'judicial') AND y >= 2014 AND y < 2017 AND pos = 1")
def _(spark, sf):
    return R.metadata_filter(corpus.chunks(spark, sf), {"doc_type": ["act", "judicial"], "y": {"gte": 2014, "lt": 2017}, "pos": 1}).select("chunk_id")


@query("r19_filter_results", f"{corpus.WITH}, s AS (SELECT chunk_id, text, v * (1 + 0.5 * ({' + '.join(f'CASE WHEN contains(lower(text), {lit(k)}) THEN 1 ELSE 0 END' for k in _KW)}) / 4) * CASE WHEN 2018 - y <= 1 THEN 1.3 WHEN 2018 - y <= 3 THEN 1.15 WHEN 2018 - y <= 5 THEN 1.05 ELSE 1.0 END AS score FROM chunks WHERE y >= 2014), r AS (SELECT *, row_number() OVER (PARTITION BY md5(substr(text, 1, 500)) ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM s) SELECT chunk_id, round(score, 6) AS score FROM r WHERE rn = 1 ORDER BY round(r.score, 9) DESC, chunk_id LIMIT 50")
def _(spark, sf):
    c = R.metadata_filter(corpus.chunks(spark, sf), {"y": {"gte": 2014}})
    c = c.withColumn("score", F.round(R.keyword_boost(F.col("v"), F.col("text"), _KW) * R.recency_boost(F.col("y"), 2018), 9))
    one = R.top_per_group(c.withColumn("h", F.md5(F.substring("text", 1, 500))), "h", 1, "score", "chunk_id")
    return one.orderBy(F.desc("score"), "chunk_id").limit(50).select("chunk_id", F.round("score", 6).alias("score"))


@query("r32_context_budget", "WITH t AS (SELECT conv_id, turn, floor(length(coalesce(text, '')) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations), s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM t WHERE position <= 5) SELECT conv_id, turn, tokens, total FROM s WHERE total <= 300")
def _(spark, sf):
    return R.within_budget(corpus.table(spark, sf, "conversations"), "conv_id", "turn", "text", 5, 300).select("conv_id", "turn", "tokens", "total")


_ANS = "'As stated [Source ' || CAST(n1 % 6 AS STRING) || '] and [Source ' || CAST(n2 % 9 + 1 AS STRING) || '], again [Source ' || CAST(n1 % 6 AS STRING) || '].'"
_CITE = f"{corpus.WITH}, a AS (SELECT chunk_id, {_ANS} AS answer FROM chunks), f AS (SELECT chunk_id, answer, list_transform(regexp_extract_all(answer, {lit(R.CITATION)}, 1), lambda x: CAST(x AS INT)) AS c FROM a), g AS (SELECT *, list_distinct(list_filter(c, lambda x: x BETWEEN 1 AND 5)) AS ok, list_distinct(list_filter(c, lambda x: NOT x BETWEEN 1 AND 5)) AS bad FROM f)"


@query("r33_citation_validation", f"{_CITE} SELECT chunk_id, len(c) AS total_citations, len(ok) AS unique_sources_cited, len(bad) AS n_invalid, len(bad) = 0 AS all_citations_valid, round(len(c) / len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')), 6) AS citation_density, round(len(ok) / 5 * 100, 6) AS sources_used_percentage FROM g")
def _(spark, sf):
    m = R.citation_check(F.expr(_ANS), F.lit(5))
    return corpus.chunks(spark, sf).select(
        "chunk_id", m["total_citations"].alias("total_citations"), m["unique_sources_cited"].alias("unique_sources_cited"), F.size(m["invalid_citations"]).alias("n_invalid"), m["all_citations_valid"].alias("all_citations_valid"),
        F.round(m["citation_density"], 6).alias("citation_density"), F.round(m["sources_used_percentage"], 6).alias("sources_used_percentage"),
    )


@query("j12_citation_sources", f"{_CITE} SELECT u.n AS source, count(*) AS n, count(*) FILTER (r_regionkey IS NULL) AS n_invalid FROM (SELECT chunk_id, unnest(list_distinct(c)) AS n FROM g) u LEFT JOIN region ON r_regionkey + 1 = u.n GROUP BY 1")
def _(spark, sf):
    a = corpus.chunks(spark, sf).select("chunk_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.expr(_ANS), F.lit(R.CITATION), F.lit(1)), lambda x: x.cast("int")))).alias("source"))
    s = corpus.table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("source"), F.lit(True).alias("known"))
    return a.join(s, "source", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("n_invalid"))


@query("r34_answer_confidence", f"{_CITE} SELECT chunk_id, round(0.5 * (chunk_id % 50) / 50.0 + CASE WHEN len(bad) = 0 THEN 0.3 ELSE 0.21 END + 0.2 * least(1.0, len(ok) / 5 * 3), 2) AS confidence FROM g")
def _(spark, sf):
    m = R.citation_check(F.expr(_ANS), F.lit(5))
    return corpus.chunks(spark, sf).select("chunk_id", R.answer_confidence((F.col("chunk_id") % 50) / 50, m["all_citations_valid"], m["unique_sources_cited"], F.lit(5)).alias("confidence"))


@query("r35_source_confidence", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.0 WHEN doc_id % 7 <= 2 THEN 0.5 WHEN doc_id % 7 <= 4 THEN 0.7 ELSE 0.9 END AS confidence FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", R.source_confidence(F.col("doc_id") % 7).alias("confidence"))


@query("r37_citation_format", f"{corpus.WITH} SELECT chunk_id, '[Source ' || CAST(pos + 1 AS STRING) || '] ' || title || ', ' || doc_type || ' (' || CAST(y AS STRING) || ')' AS out FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.format_string("[Source %d] %s, %s (%d)", F.col("pos") + 1, "title", "doc_type", "y").alias("out"))


@query("r38_precision_recall", "WITH f AS (SELECT DISTINCT lang, doc_id FROM documents WHERE n_chars >= 1500), r AS (SELECT DISTINCT lang, doc_id FROM documents WHERE length(text) >= 1000 AND n_chars < 4000), h AS (SELECT lang, count(*) AS h FROM f JOIN r USING (lang, doc_id) GROUP BY 1) SELECT lang, round(h / (SELECT count(*) FROM f WHERE f.lang = h.lang), 6) AS precision, round(h / (SELECT count(*) FROM r WHERE r.lang = h.lang), 6) AS recall FROM h")
def _(spark, sf):
    d = _docs(spark, sf).select("lang", "doc_id")
    return R.precision_recall(d.where("n_chars >= 1500"), d.where("length(text) >= 1000 AND n_chars < 4000"), "lang", "doc_id").select("lang", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("f09_domain_allow_list", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages WHERE regexp_matches(regexp_extract(url, '^https?://([^/:?#]+)', 1), '(^|\\.)example\\.(com|org)$')")
def _(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    return corpus.table(spark, sf, "pages").select("page_id", host.alias("host")).where(F.col("host").rlike(r"(^|\.)example\.(com|org)$"))


@query("f10_external_quality", "SELECT doc_id FROM documents WHERE length(text) >= 100 AND regexp_matches(text, '\\S')")
def _(spark, sf):
    return _docs(spark, sf).where((F.length("text") >= 100) & F.col("text").rlike(r"\S")).select("doc_id")


@query("f11_validate_query", "SELECT doc_id, length(trim(coalesce(text, ''))) BETWEEN 1 AND 1000 AS valid FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.length(F.trim(F.coalesce("text", F.lit("")))).between(1, 1000).alias("valid"))


@query("j09_precedent_graph", f"{corpus.WITH}, n AS (SELECT n_nationkey, lower(n_name) AS name FROM nation) SELECT n_nationkey, count(*) AS n FROM n JOIN part ON contains(lower(p_name || ' ' || p_type || ' ' || CASE WHEN p_partkey % 5 = 0 THEN (SELECT min(name) FROM n) ELSE '' END), name) GROUP BY 1")
def _(spark, sf):
    n = corpus.table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    least = n.agg(F.min("name").alias("least"))
    p = corpus.table(spark, sf, "part").crossJoin(F.broadcast(least)).select(F.lower(F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_partkey") % 5 == 0, F.col("least")).otherwise(""))).alias("t"))  # least: one row
    return p.join(F.broadcast(n), F.col("t").contains(F.col("name"))).groupBy("n_nationkey").agg(F.count("*").alias("n"))  # nations: a fixed short list


@query("r17_important_keywords", f"{corpus.WITH} SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(text), 'section\\s+\\d+(?:\\(\\d+\\))?(?:\\([a-z]\\))?') || regexp_extract_all(lower(text), 'article\\s+\\d+[a-z]?') || list_transform(regexp_extract_all(text, '\\b[A-Z]{{3,5}}\\b'), lambda x: lower(x)))) AS keyword FROM chunks")
def _(spark, sf):
    low = F.lower("text")
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in (r"section\s+\d+(?:\(\d+\))?(?:\([a-z]\))?", r"article\s+\d+[a-z]?")], F.transform(F.regexp_extract_all("text", F.lit(r"\b[A-Z]{3,5}\b"), F.lit(0)), lambda x: F.lower(x)))
    return corpus.chunks(spark, sf).select("chunk_id", F.explode(F.array_distinct(found)).alias("keyword"))


_LEGAL = (("act", 0.2), ("section", 0.2), ("rule", 0.1), ("article", 0.05))


@query("r20_legal_rank", f"{corpus.WITH}, s AS (SELECT chunk_id, v / 900.0 AS score, least(1.0, CASE WHEN contains(lower(text), 'section 12') THEN 0.4 ELSE 0 END + {' + '.join(f'CASE WHEN contains(lower(text), {lit(k)}) THEN {w} ELSE 0 END' for k, w in _LEGAL)}) AS legal FROM chunks) SELECT chunk_id, round(0.7 * score + 0.3 * legal, 6) AS combined FROM s ORDER BY round(0.7 * s.score + 0.3 * s.legal, 9) DESC, chunk_id LIMIT 40")
def _(spark, sf):
    low = F.lower("text")
    legal = F.least(F.lit(1.0), F.when(low.contains("section 12"), 0.4).otherwise(0.0) + sum((F.when(low.contains(k), w).otherwise(0.0) for k, w in _LEGAL), F.lit(0.0)))
    c = corpus.chunks(spark, sf).select("chunk_id", (0.7 * F.col("v") / 900 + 0.3 * legal).alias("c"))
    return c.orderBy(F.desc(F.round("c", 9)), "chunk_id").limit(40).select("chunk_id", F.round("c", 6).alias("combined"))
