"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..operators import aggregates as A
from ..operators import graph as G
from . import corpus
from .duck import has, lit

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


W = corpus.WITH


@query("a01_chunks_by_document", f"{W} SELECT doc_id, count(*) AS n, string_agg(CAST(chunk_id AS STRING), ',' ORDER BY pos) AS chunk_ids FROM chunks GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))).alias("p"))
    return c.select("doc_id", "n", F.array_join(F.transform("p", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"))


_ACR = lit(E.SIMPLE["acronyms"][0])


@query("a02_entities_by_document", f"{W}, e AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, {_ACR})) AS v FROM chunks) SELECT doc_id, v AS value, min(pos) AS first_pos, count(*) AS n FROM e GROUP BY 1, 2")
def _(spark, sf):
    e = corpus.chunks(spark, sf).select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit(E.SIMPLE["acronyms"][0]), F.lit(0))).alias("value"))
    return e.groupBy("doc_id", "value").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


@query("a03_document_metadata", f"{W} SELECT doc_id, arg_min(title, pos) AS title, sum(length(text))::BIGINT AS chars, count(*) AS n FROM chunks GROUP BY 1")
def _(spark, sf):
    return corpus.chunks(spark, sf).groupBy("doc_id").agg(F.min_by("title", "pos").alias("title"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))


@query("a04_type_rollup", f"{W} SELECT doc_type, prio, count(*) AS n FROM chunks GROUP BY ROLLUP (doc_type, prio)")
def _(spark, sf):
    return corpus.chunks(spark, sf).rollup("doc_type", "prio").agg(F.count("*").alias("n"))


_DIST = "CASE " + " ".join(f"WHEN contains(lower(text), {lit(d.lower())}) THEN {lit(d)}" for d in A.DISTRICTS) + " END"
_YEAR = "CASE WHEN regexp_extract(text, '(\\d{4})-?(\\d{2})', 1) <> '' THEN regexp_extract(text, '(\\d{4})-?(\\d{2})', 1) || '-' || regexp_extract(text, '(\\d{4})-?(\\d{2})', 2) WHEN regexp_extract(text, '\\b(20\\d{2})\\b', 1) <> '' THEN regexp_extract(text, '\\b(20\\d{2})\\b', 1) END"
_VAL = (
    f"CASE WHEN regexp_extract(s, {lit(A.RATIO)}) <> '' THEN TRY_CAST(regexp_extract(s, {lit(A.RATIO)}, 1) AS DOUBLE) / TRY_CAST(regexp_extract(s, {lit(A.RATIO)}, 2) AS DOUBLE) "
    f"ELSE TRY_CAST(replace(regexp_extract(s, {lit(A.NUMBER)}), ',', '') AS DOUBLE) * CASE WHEN contains(lower(s), 'crore') THEN 1e7 WHEN contains(lower(s), 'lakh') THEN 1e5 ELSE 1 END END"
)
_UNIT = f"CASE WHEN regexp_extract(s, {lit(A.RATIO)}) <> '' THEN 'ratio' WHEN contains(lower(s), 'crore') THEN 'crore' WHEN contains(lower(s), 'lakh') THEN 'lakh' WHEN {has('s', A.NUMBER + r'\s*%')} THEN 'percentage' END"
_POINTS = (
    f"{W}, s0 AS (SELECT chunk_id, text, regexp_split_to_array(text, '[.!?]\\s+') AS ss FROM chunks), s AS (SELECT chunk_id, text, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sentence_no FROM s0), "
    f"m AS ({' UNION ALL '.join(f'SELECT *, {lit(k)} AS metric FROM s WHERE {has("s", p)}' for k, p in A.METRICS.items())}), "
    f"points AS (SELECT chunk_id, sentence_no, metric, {_VAL} AS value, {_UNIT} AS unit, {_YEAR} AS year, {_DIST} AS district FROM m WHERE {_VAL} IS NOT NULL)"
)


@query("a08_data_points", f"{_POINTS} SELECT chunk_id, sentence_no, metric, round(value, 6) AS value, unit, year, district FROM points")
def _(spark, sf):
    return A.data_points(corpus.chunks(spark, sf)).withColumn("value", F.round("value", 6))


@query("a05_metric_catalog", f"{_POINTS} SELECT metric, count(*) AS n_points, arg_min(coalesce(unit, ''), chunk_id * 100 + sentence_no) AS unit, count(DISTINCT year) AS n_years FROM points GROUP BY 1")
def _(spark, sf):
    return A.metric_catalog(A.data_points(corpus.chunks(spark, sf)).withColumn("unit", F.coalesce("unit", F.lit(""))))


@query("a06_time_series", f"{_POINTS} SELECT metric, year, round(CASE WHEN metric = 'enrollment' THEN sum(value) ELSE avg(value) END, 4) AS value, count(*) AS n FROM points WHERE value <> 0 AND year IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return A.time_series(A.data_points(corpus.chunks(spark, sf))).withColumn("value", F.round("value", 4))


@query("a07_district_breakdown", f"{_POINTS} SELECT district, metric, round(arg_max(value, chunk_id * 100 + sentence_no), 6) AS value FROM points WHERE district IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return A.breakdown(A.data_points(corpus.chunks(spark, sf)), "district").withColumn("value", F.round("value", 6))


@query("a09_category", f"{W} SELECT chunk_id, CASE {' '.join(f'WHEN {has("text", rf"(?i)\b{k}\b")} THEN {lit(k)}' for k in A.CATEGORIES)} END AS category, {_DIST} AS district, {_YEAR} AS year FROM chunks")
def _(spark, sf):
    t = F.col("text")
    return corpus.chunks(spark, sf).select("chunk_id", A.first_category(t).alias("category"), A.first_district(t).alias("district"), A.report_year(t).alias("year"))


_OWN = f"nullif(regexp_extract(text, {lit(G.OWN_NUMBER)}, 1), '')"
_TG = " UNION ALL ".join(f"SELECT CAST(unnest(regexp_extract_all(text, {lit(p)}, 1)) AS INT) AS target FROM chunks WHERE {_OWN} IS NOT NULL" for _, _, p in G.SUPERSESSION)


@query("a11_order_status", f"{W}, t AS (SELECT DISTINCT target FROM ({_TG}) x), o AS (SELECT chunk_id, CAST({_OWN} AS INT) AS number, y, kind FROM chunks WHERE {_OWN} IS NOT NULL) SELECT CASE WHEN target IS NOT NULL THEN 'superseded' WHEN kind = 7 THEN 'active' WHEN 2026 - y > 10 THEN 'likely_superseded' ELSE 'active' END AS status, count(*) AS n FROM o LEFT JOIN t ON number = target GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    own = F.regexp_extract("text", G.OWN_NUMBER, 1)
    o = c.select("kind", "y", F.when(own != "", own).cast("int").alias("number")).where("number is not null")
    return A.order_status(o, G.supersessions(c), "number", "y", 2026, F.col("kind") == 7).groupBy("status").agg(F.count("*").alias("n"))


@query("a12_orders_timeline", f"{W} SELECT y, doc_type, count(*) AS n, count(DISTINCT n1) AS n_numbers, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1, 2")
def _(spark, sf):
    return corpus.chunks(spark, sf).groupBy("y", "doc_type").agg(F.count("*").alias("n"), F.countDistinct("n1").alias("n_numbers"), F.min("chunk_id").alias("first_chunk"))


_SEC = r"(?i)\bSection\s+(\d+)"


@query("a13_section_hierarchy", f"{W}, r AS (SELECT doc_id, chunk_id, unnest(regexp_extract_all(text, {lit(_SEC)}, 1)) AS section FROM chunks) SELECT doc_id, section, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_mentions FROM r GROUP BY 1, 2")
def _(spark, sf):
    r = corpus.chunks(spark, sf).select("doc_id", "chunk_id", F.explode(F.regexp_extract_all("text", F.lit(_SEC), F.lit(1))).alias("section"))
    return r.groupBy("doc_id", "section").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_mentions"))


@query("a14_cited_by", f"{W}, r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {lit(_SEC)}, 1)) AS section FROM chunks) SELECT section, count(*) AS cited_by, min(doc_id) AS first_doc FROM r GROUP BY 1")
def _(spark, sf):
    r = corpus.chunks(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_SEC), F.lit(1))).alias("section")).distinct()
    return r.groupBy("section").agg(F.count("*").alias("cited_by"), F.min("doc_id").alias("first_doc"))


@query("a15_amendments", f"{W} SELECT y, CASE WHEN contains(lower(text), 'substituted') THEN 'substitution' WHEN contains(lower(text), 'inserted') OR contains(lower(text), 'added') THEN 'insertion' WHEN contains(lower(text), 'omitted') OR contains(lower(text), 'deleted') THEN 'deletion' WHEN contains(lower(text), 'supersession') THEN 'supersession' ELSE 'modification' END AS amendment, count(*) AS n FROM chunks WHERE {has('text', A.AMENDMENT)} GROUP BY 1, 2")
def _(spark, sf):
    return corpus.chunks(spark, sf).where(F.col("text").rlike(A.AMENDMENT)).groupBy("y", A.amendment_kind(F.col("text")).alias("amendment")).agg(F.count("*").alias("n"))


@query("a16_key_sections", f"{W}, r AS (SELECT doc_type, chunk_id, unnest(regexp_extract_all(text, {lit(_SEC)}, 1)) AS section FROM chunks), s AS (SELECT doc_type, section, 2 * count(DISTINCT chunk_id) + count(*) AS weight FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY weight DESC, section) AS rank FROM s) SELECT doc_type, section, weight, rank FROM k WHERE rank <= 10")
def _(spark, sf):
    return A.top_sections(corpus.chunks(spark, sf), _SEC)


@query("a18_case_entries", f"{W} SELECT chunk_id, trim(regexp_extract(text, 'petitioner, ([^.]+?) vs\\. ([A-Z][A-Za-z ]+)', 1)) AS petitioner, trim(regexp_extract(text, 'petitioner, ([^.]+?) vs\\. ([A-Z][A-Za-z ]+)', 2)) AS respondent, CASE WHEN {has('text', A.CASE_STATUS[0][1])} THEN 'decided' WHEN {has('text', A.CASE_STATUS[1][1])} THEN 'pending' WHEN {has('text', A.CASE_STATUS[2][1])} THEN 'interim' ELSE 'unknown' END AS status FROM chunks")
def _(spark, sf):
    p = r"petitioner, ([^.]+?) vs\. ([A-Z][A-Za-z ]+)"
    c = corpus.chunks(spark, sf)
    return c.select("chunk_id", F.trim(F.regexp_extract("text", p, 1)).alias("petitioner"), F.trim(F.regexp_extract("text", p, 2)).alias("respondent"), A.case_status(F.col("text")).alias("status"))


_BUD = r"(?i)(\d+(?:,\d+)*(?:\.\d+)?)\s*(crore|lakh|thousand)"
_CR = f"TRY_CAST(replace(regexp_extract(text, {lit(_BUD)}, 1), ',', '') AS DOUBLE) / CASE lower(regexp_extract(text, {lit(_BUD)}, 2)) WHEN 'crore' THEN 1 WHEN 'lakh' THEN 100 WHEN 'thousand' THEN 10000 END"


@query("a20_scheme_budgets", f"{W} SELECT chunk_id, round({_CR}, 6) AS crore FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.round(A.budget_crore(F.col("text")), 6).alias("crore"))


@query("a21_budget_summary", f"{W} SELECT {_DIST} AS district, y, round(sum({_CR}), 4) AS crore, count(*) AS n FROM chunks GROUP BY CUBE (1, 2)".replace("CUBE (1, 2)", f"CUBE ({_DIST}, y)"))
def _(spark, sf):
    c = corpus.chunks(spark, sf).select(A.first_district(F.col("text")).alias("district"), "y", A.budget_crore(F.col("text")).alias("crore"))
    return c.cube("district", "y").agg(F.round(F.sum("crore"), 4).alias("crore"), F.count("*").alias("n"))


@query("a22_corpus_statistics", "SELECT count(*) AS total_documents, count(*) FILTER (length(text) > 100) AS successful, round(count(*) FILTER (length(text) > 100) / count(*), 6) AS success_rate, round(avg(length(text)), 4) AS mean_chars, count(DISTINCT source) AS n_sources FROM documents")
def _(spark, sf):
    ok = F.count_if(F.length("text") > 100)
    return corpus.table(spark, sf, "documents").agg(F.count("*").alias("total_documents"), ok.alias("successful"), F.round(ok / F.count("*"), 6).alias("success_rate"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.countDistinct("source").alias("n_sources"))


_ENT = [(k, p) for k in ("acronyms", "districts", "schemes") for p in E.SIMPLE[k]]
_ENTSQL = " UNION ALL ".join(f"SELECT chunk_id, lower(unnest(regexp_extract_all(text, {lit(p)}))) AS v FROM chunks" for _, p in _ENT)


@query("a25_topic_suggestions", f"{W}, e AS (SELECT DISTINCT chunk_id, v FROM ({_ENTSQL}) x) SELECT a.v AS left_value, b.v AS right_value, count(*) AS n, least(count(*) / 10, 0.9) AS confidence FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.v < b.v GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    e = c.select("chunk_id", F.explode(F.transform(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for _, p in _ENT]), lambda x: F.lower(x))).alias("v"))
    return A.co_occurrence(e, "chunk_id", "v", 3)


@query("a26_coverage", f"{W}, d AS (SELECT doc_id, max(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS o, max(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS a FROM chunks GROUP BY 1) SELECT count(*) AS n, round(100 * sum(o) / count(*), 4) AS orders_percent, round(100 * sum(a) / count(*), 4) AS acts_percent FROM d")
def _(spark, sf):
    d = corpus.chunks(spark, sf).groupBy("doc_id").agg(F.max((F.col("kind") == 0).cast("int")).alias("o"), F.max((F.col("kind") == 1).cast("int")).alias("a"))
    return d.agg(F.count("*").alias("n"), F.round(100 * F.sum("o") / F.count("*"), 4).alias("orders_percent"), F.round(100 * F.sum("a") / F.count("*"), 4).alias("acts_percent"))


@query("a29_usage_rollup", "SELECT event_type, count(*) AS calls, sum(user_id)::BIGINT AS input_tokens, round(sum(user_id * 3 / 1e6 + event_id % 100 * 15 / 1e6), 6) AS cost FROM events GROUP BY ROLLUP (event_type)")
def _(spark, sf):
    cost = F.col("user_id") * 3 / 1e6 + F.col("event_id") % 100 * 15 / 1e6
    return corpus.table(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.sum("user_id").alias("input_tokens"), F.round(F.sum(cost), 6).alias("cost"))


@query("a31_embedding_statistics", "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM embeddings GROUP BY 1")
def _(spark, sf):
    from ..operators.retrieval import dot

    return corpus.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(dot(F.col("embedding"), F.col("embedding")))), 6).alias("mean_norm"))


@query("a32_duplicate_ratio", "SELECT round(1 - count(DISTINCT md5(text)) / count(*), 6) AS ratio, count(*) - count(DISTINCT md5(text)) AS n_extra FROM documents")
def _(spark, sf):
    n, d = F.count("*"), F.countDistinct(F.md5(F.col("text")))
    return corpus.table(spark, sf, "documents").agg(F.round(1 - d / n, 6).alias("ratio"), (n - d).alias("n_extra"))


@query("a34_distinct_sources", "SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY 1")
def _(spark, sf):
    return corpus.table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct(F.md5("text")).alias("n_texts"))


@query("x07_type_distribution", f"{W} SELECT doc_type, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rank FROM chunks GROUP BY 1")
def _(spark, sf):
    from pyspark.sql import Window

    g = corpus.chunks(spark, sf).groupBy("doc_type").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))))  # a row per type


@query("x11_recommendations", "WITH s AS (SELECT lang, avg(length(text)) AS mean_chars, count(*) AS n FROM documents GROUP BY 1) SELECT lang, unnest(list_filter([CASE WHEN mean_chars < 2500 THEN 'collect longer texts' END, CASE WHEN n < 300 THEN 'collect more documents' END, 'review sources'], lambda x: x IS NOT NULL)) AS recommendation FROM s")
def _(spark, sf):
    s = corpus.table(spark, sf, "documents").groupBy("lang").agg(F.avg(F.length("text")).alias("m"), F.count("*").alias("n"))
    r = F.filter(F.array(F.when(F.col("m") < 2500, "collect longer texts"), F.when(F.col("n") < 300, "collect more documents"), F.lit("review sources")), lambda x: x.isNotNull())
    return s.select("lang", F.explode(r).alias("recommendation"))


@query("x17_fallback_results", f"{W}, r AS (SELECT *, row_number() OVER (PARTITION BY n1 ORDER BY v DESC, chunk_id) AS rn FROM chunks) SELECT n1, chunk_id, v FROM r WHERE rn = 1 ORDER BY v DESC, chunk_id LIMIT 15")
def _(spark, sf):
    from ..operators.retrieval import top_per_group

    return top_per_group(corpus.chunks(spark, sf), "n1", 1, "v", "chunk_id").orderBy(F.desc("v"), "chunk_id").limit(15).select("n1", "chunk_id", "v")


@query("x18_context_text", f"{W} SELECT doc_id, string_agg('[' || CAST(pos + 1 AS STRING) || '] ' || title, '; ' ORDER BY pos) AS context FROM chunks GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title"))).alias("p"))
    return c.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), (x["pos"] + 1).cast("string"), F.lit("] "), x["title"])), "; ").alias("context"))
