"""Queries of the text, classification, extraction and quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dictionaries as D
from ..functions import extract as E
from ..functions import quality as Q
from ..functions import text as T
from ..operators import dedup as U
from ..operators import set_join
from . import corpus
from .duck import count, has, lit, rewrite

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _text_query(name: str, rules, f):
    def run(spark, sf):
        return corpus.chunks(spark, sf).select("chunk_id", f(F.col("text")).alias("out"))

    QUERIES[name] = (run, f"{corpus.WITH} SELECT chunk_id, {rewrite('text', rules)} AS out FROM chunks")


for _n, _rules, _f in (
    ("t01_fix_ocr", T.OCR_RULES, T.fix_ocr),
    ("t01b_fix_ocr_literal", (*T.OCR_RULES[:2], T.OCR_RN_RULE, T.OCR_RULES[2]), lambda c: T.fix_ocr(c, True)),
    ("t02_fix_hyphenation", T.HYPHEN_RULES, T.fix_hyphenation),
    ("t03_normalize_unicode", T.UNICODE_RULES, T.normalize_unicode),
    ("t04_page_furniture", T.PAGE_RULES, T.remove_page_furniture),
    ("t05_standardize_orders", T.GO_RULES, T.standardize_orders),
    ("t06_standardize_dates", T.DATE_RULES, T.standardize_dates),
    ("t07_standardize_sections", T.SECTION_RULES, T.standardize_sections),
    ("t08_remove_artifacts", T.ARTIFACT_RULES, T.remove_artifacts),
    ("t09_normalize_whitespace", T.SPACE_RULES, T.normalize_whitespace),
    ("t10_remove_special", T.SPECIAL_KEEP, T.remove_special),
    ("t10b_remove_special_all", T.SPECIAL_DROP, lambda c: T.remove_special(c, False)),
    ("t11_clean", T.CLEAN_RULES, T.clean),
    ("t11b_clean_aggressive", (*T.CLEAN_RULES, *T.SPECIAL_DROP), lambda c: T.clean(c, True)),
):
    _text_query(_n, _rules, _f)

_CMP = rewrite("lower(coalesce(text, ''))", T.COMPARE_RULES)


@query("t12_comparison_form", f"SELECT doc_id, {_CMP} AS out FROM documents")
def _(spark, sf):
    return corpus.table(spark, sf, "documents").select("doc_id", T.for_comparison(F.col("text")).alias("out"))


_WRONG = "'The ' || CASE WHEN c_custkey % 3 = 0 THEN 'goverment' WHEN c_custkey % 3 = 1 THEN 'Sceme' ELSE 'TEACHR' END || ' enrolment in vizag ' || c_mktsegment"


@query(
    "t15_query_spelling",
    f"SELECT c_custkey, array_to_string(list_transform(string_split({_WRONG}, ' '), lambda w: CASE "
    + " ".join(
        f"WHEN lower(w) = {lit(k)} THEN CASE WHEN w = upper(w) THEN {lit(v.upper())} WHEN substr(w, 1, 1) = upper(substr(w, 1, 1)) THEN {lit(v[0].upper() + v[1:])} ELSE {lit(v)} END" for k, v in D.SPELLING.items()
    )
    + " ELSE w END), ' ') AS out FROM customer",
)
def _(spark, sf):
    return corpus.table(spark, sf, "customer").select("c_custkey", T.spelling(F.expr(_WRONG), D.SPELLING).alias("out"))


@query("t16_expand_acronyms", f"{corpus.WITH} SELECT chunk_id, {rewrite('text', [(T.acronym_pattern(k), rf'\1 ({D.ACRONYMS[k]})') for k in sorted(D.ACRONYMS, key=lambda k: (-len(k), k))])} AS out FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", T.expand_acronyms(F.col("text"), D.ACRONYMS).alias("out"))


@query("t17_canonical_districts", f"SELECT c_custkey, {rewrite(_WRONG, [(rf'(?i)\b{k}\b', v) for k, v in D.DISTRICT_ALIASES.items()])} AS out FROM customer")
def _(spark, sf):
    return corpus.table(spark, sf, "customer").select("c_custkey", T.canonical_names(F.expr(_WRONG), D.DISTRICT_ALIASES).alias("out"))


@query("t19_substantially_different", f"{corpus.WITH} SELECT chunk_id, lower(trim(text)) <> lower(trim(title)) AS out FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", (F.lower(F.trim("text")) != F.lower(F.trim("title"))).alias("out"))


@query("e30_first_number", f"{corpus.WITH} SELECT chunk_id, TRY_CAST(replace(regexp_extract(text, {lit(r'\d+(?:,\d+)*(?:\.\d+)?')}), ',', '') AS DOUBLE) AS out FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", T.first_number(F.col("text")).alias("out"))


# Classification

_FULL, _HEAD = "lower(title || ' ' || text)", "lower(title)"
_SCORES = {k: " + ".join(f"{w} * {count(src, p)}" for patterns, src, w in zip(g, (_FULL, _FULL, _HEAD), C.WEIGHTS, strict=True) for p in patterns) for k, g in C.TYPE_PATTERNS.items()}
_SCORED = f"{corpus.WITH}, s AS (SELECT chunk_id, text, doc_type, {', '.join(f'{v} AS s_{k}' for k, v in _SCORES.items())} FROM chunks), b AS (SELECT *, greatest({', '.join(f's_{k}' for k in _SCORES)}) AS best FROM s)"
_FIRST = "CASE " + " ".join(f"WHEN s_{k} = best THEN {lit(k)}" for k in _SCORES) + " END"


@query("c01_rule_scores", f"{_SCORED} SELECT chunk_id, {', '.join(f'CAST(s_{k} AS DOUBLE) AS s_{k}' for k in _SCORES)} FROM b")
def _(spark, sf):
    c = C.with_lower(corpus.chunks(spark, sf), "text", "title")
    return c.select("chunk_id", *[v.alias(f"s_{k}") for k, v in C.type_scores(F.col("_full"), F.col("_head")).items()])


@query(
    "c02_classify",
    f"{_SCORED} SELECT chunk_id, {_FIRST} AS predicted_type, CAST(CASE WHEN best > 0 THEN 1 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN best > 0 THEN 'high' ELSE 'low' END AS confidence_level, 'rule_based' AS method FROM b",
)
def _(spark, sf):
    return C.classify(corpus.chunks(spark, sf)).select("chunk_id", "predicted_type", "confidence", "confidence_level", "method")


_FOLDERS = "CASE n1 % 5 WHEN 0 THEN 'Acts' WHEN 1 THEN 'my_budget_files' WHEN 2 THEN 'misc' WHEN 3 THEN 'Government_Orders' ELSE 'old policy' END"
_FMAP = " ".join(f"WHEN lower({_FOLDERS}) = {lit(k)} THEN {lit(v)}" for k, v in C.FOLDER_TYPES.items()) + " " + " ".join(f"WHEN contains(lower({_FOLDERS}), {lit(k)}) THEN {lit(v)}" for k, v in C.FOLDER_TYPES.items())


@query("c03_folder_type", f"{corpus.WITH} SELECT chunk_id, CASE {_FMAP} END AS folder_type FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", C.folder_type(F.array(F.lit("data"), F.expr(_FOLDERS))).alias("folder_type"))


_NW = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@query(
    "c04_structural_features",
    f"{corpus.WITH}, f AS (SELECT *, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S')) AS ss FROM chunks) SELECT chunk_id, {', '.join(f'{has("text", p)} AS {k}' for k, p in C.FEATURES.items())}, "
    f"{_NW.format('text')} AS word_count, {_NW.format('title')} AS title_length, round(list_sum(list_transform(ss, lambda s: {_NW.format('s')})) / len(ss), 6) AS avg_sentence_length FROM f",
)
def _(spark, sf):
    f = C.structural_features(F.col("text"), F.col("title"))
    f["avg_sentence_length"] = F.round(f["avg_sentence_length"], 6)
    return corpus.chunks(spark, sf).select("chunk_id", *[v.alias(k) for k, v in f.items()])


@query(
    "c05_classification_statistics",
    f"{_SCORED}, p AS (SELECT {_FIRST} AS predicted_type, CASE WHEN best > 0 THEN 'high' ELSE 'low' END AS confidence_level, CASE WHEN best > 0 THEN 1 ELSE 0 END AS confidence FROM b) "
    "SELECT predicted_type, confidence_level, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM p GROUP BY GROUPING SETS ((predicted_type), (confidence_level), ())",
)
def _(spark, sf):
    c = C.classify(corpus.chunks(spark, sf)).select("predicted_type", "confidence_level", "confidence")
    g = c.groupingSets([["predicted_type"], ["confidence_level"], []], "predicted_type", "confidence_level")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


_PATH = "'/data/My Acts/GO_MS_No_' || CAST(n1 AS STRING) || '-' || CAST(y AS STRING) || ' final.pdf'"


@query(
    "c07_path_metadata",
    f"{corpus.WITH}, p AS (SELECT chunk_id, {_PATH} AS path, y, n1 FROM chunks) SELECT chunk_id, replace(replace(lower('my acts_' || regexp_extract(path, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1)), ' ', '_'), '-', '_') AS doc_id, y AS year, n1 AS go_number FROM p",
)
def _(spark, sf):
    m = C.path_metadata(F.expr(_PATH))
    return corpus.chunks(spark, sf).select("chunk_id", m["doc_id"].alias("doc_id"), m["year"].alias("year"), m["go_number"].alias("go_number"))


@query(
    "c09_semantic_features",
    f"{corpus.WITH} SELECT chunk_id, CASE {' '.join(f'WHEN {has("text", p)} THEN {lit(k)}' for k, p in C.SEMANTIC_TYPES)} ELSE 'general' END AS semantic_type, CASE WHEN {_NW.format('text')} < 20 THEN 'simple' WHEN {_NW.format('text')} < 30 THEN 'moderate' ELSE 'complex' END AS complexity FROM chunks",
)
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", C.semantic_type(F.col("text")).alias("semantic_type"), C.complexity(F.col("text"), (20, 30)).alias("complexity"))


@query(
    "c11_embedding_text",
    f"{corpus.WITH} SELECT chunk_id, 'Document: ' || title || ' Type: ' || doc_type || CASE WHEN y >= 2015 THEN ' Year: ' || CAST(y AS STRING) ELSE '' END || ' ' || text AS out FROM chunks",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    return c.select("chunk_id", F.concat_ws(" ", F.concat(F.lit("Document: "), "title"), F.concat(F.lit("Type: "), "doc_type"), F.when(F.col("y") >= 2015, F.concat(F.lit("Year: "), F.col("y").cast("string"))), "text").alias("out"))


_COLL = " ".join(f"WHEN doc_type = {lit(k)} THEN {lit(v)}" for k, v in C.COLLECTIONS.items()) + " " + " ".join(f"WHEN contains(doc_type, {lit(k)}) OR contains({lit(k)}, doc_type) THEN {lit(v)}" for k, v in C.COLLECTIONS.items())


@query("c12_collection_mapping", f"{corpus.WITH} SELECT CASE {_COLL} ELSE 'external_sources' END AS collection, count(*) AS n FROM chunks GROUP BY 1")
def _(spark, sf):
    return corpus.chunks(spark, sf).groupBy(C.collection_of(F.col("doc_type")).alias("collection")).agg(F.count("*").alias("n"))


# Extraction

for _name, _pats in E.SIMPLE.items():

    def _run(spark, sf, pats=_pats):
        return corpus.chunks(spark, sf).select("chunk_id", F.explode(E.matches(F.col("text"), pats)).alias("value"))

    QUERIES[f"e_{_name}"] = (
        _run,
        f"{corpus.WITH} SELECT chunk_id, unnest(list_distinct(list_transform({' || '.join(f'regexp_extract_all(text, {lit(p)})' for p in _pats)}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS value FROM chunks",
    )


@query(
    "e01_order_references",
    f"{corpus.WITH}, r AS (SELECT chunk_id, unnest(regexp_extract_all(text, {lit(E.ORDER_PATTERN)})) AS m FROM chunks), p AS (SELECT chunk_id, regexp_extract(m, {lit(E.ORDER_PATTERN)}, ['n', 'y', 'd1', 'd2']) AS g FROM r) "
    "SELECT DISTINCT chunk_id, 'G.O.MS.No. ' || g.n || CASE WHEN g.y <> '' THEN '/' || g.y WHEN g.d1 <> '' THEN ' dated ' || g.d1 WHEN g.d2 <> '' THEN ' dated ' || g.d2 ELSE '' END AS ref FROM p",
)
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.explode(E.order_references(F.col("text"))).alias("ref"))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


@query(
    "e06_keywords",
    f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents), k AS (SELECT doc_id, word, count(*) AS n, min(i) AS first FROM w WHERE regexp_full_match(word, '[a-z]{{4,}}') AND word NOT IN ({', '.join(map(lit, E.STOP_WORDS))}) GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM k) SELECT doc_id, word, n, rank FROM r WHERE rank <= 20",
)
def _(spark, sf):
    return E.keywords(corpus.table(spark, sf, "documents"), 20)


_REL = " UNION ALL ".join(f"SELECT chunk_id, {i} AS seq, {lit(kind)} AS relation_type, CAST({conf} AS DOUBLE) AS confidence, unnest(regexp_extract_all(text, {lit(p)})) AS raw, {lit(p)} AS p, {g} AS g FROM chunks" for i, (kind, conf, p, g) in enumerate(E.RELATIONS))


@query(
    "e12_relations",
    f"{corpus.WITH}, r AS ({_REL}), t AS (SELECT chunk_id, seq, relation_type, confidence, lower(CASE "
    + " ".join(f"WHEN seq = {i} THEN regexp_extract(raw, {lit(p)}, {g})" for i, (_, _, p, g) in enumerate(E.RELATIONS))
    + " END) AS target FROM r) SELECT chunk_id, relation_type, target, min(confidence) AS confidence, count(*) AS n FROM t GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return E.relations(corpus.chunks(spark, sf), "chunk_id", "text")


@query(
    "e16_graph_entities",
    f"{corpus.WITH}, e AS ("
    + " UNION ALL ".join(f"SELECT chunk_id, {lit(kind)} AS entity_type, unnest(regexp_extract_all(text, {lit(p)}, 1)) AS value, lower(text) AS low FROM chunks" for kind, pats in E.GRAPH_ENTITIES.items() for p in pats)
    + f") SELECT entity_type, lower(value) AS value, count(DISTINCT chunk_id) AS n_chunks, round(max(least(1.0, greatest(0.1, 0.8 + CASE WHEN {has('low', E.FORMAL)} THEN 0.1 ELSE 0 END + CASE WHEN entity_type = 'legal_section' AND contains(low, 'section') THEN 0.1 ELSE 0 END - CASE WHEN {has('low', E.HEDGED)} THEN 0.1 ELSE 0 END))), 6) AS confidence FROM e GROUP BY 1, 2",
)
def _(spark, sf):
    e = E.graph_entities(corpus.chunks(spark, sf), "chunk_id", "text")
    return e.groupBy("entity_type", F.lower("value").alias("value")).agg(F.countDistinct("chunk_id").alias("n_chunks"), F.round(F.max("confidence"), 6).alias("confidence"))


_P2 = "lpad(regexp_extract(raw, {}, {}), 2, '0')"


@query(
    "e24_dates",
    f"{corpus.WITH}, r AS (SELECT chunk_id, unnest(regexp_extract_all(text, {lit(E.DATE_DMY)})) AS raw FROM chunks) SELECT chunk_id, raw, regexp_extract(raw, {lit(E.DATE_DMY)}, 3) || '-' || {_P2.format(lit(E.DATE_DMY), 2)} || '-' || {_P2.format(lit(E.DATE_DMY), 1)} AS normalized FROM r",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(E.DATE_DMY), F.lit(0))).alias("raw"))
    return c.select("chunk_id", "raw", E.parse_date(F.col("raw")).alias("normalized"))


@query(
    "e22_parse_month_dates",
    # Only orders and judgments say "dated", in two ways; the other texts give no date here.
    f"{corpus.WITH} SELECT chunk_id, CASE kind WHEN 4 THEN CAST(y AS STRING) || '-03-' || lpad(CAST(d AS STRING), 2, '0') END AS normalized FROM chunks",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    return c.select("chunk_id", E.parse_date(F.regexp_extract("text", r"dated ([^.]+)\.", 1)).alias("normalized"))


@query(
    "e23_academic_years",
    f"{corpus.WITH}, r AS (SELECT chunk_id, unnest(regexp_extract_all(text, {lit(E.ACADEMIC_YEAR)})) AS raw FROM chunks), g AS (SELECT chunk_id, regexp_extract(raw, {lit(E.ACADEMIC_YEAR)}, 1) AS a, regexp_extract(raw, {lit(E.ACADEMIC_YEAR)}, 2) AS b FROM r) "
    "SELECT chunk_id, CAST(a AS INT) AS start_year, CAST(CASE WHEN length(b) = 2 THEN substr(a, 1, 2) || b ELSE b END AS INT) AS end_year FROM g",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(E.ACADEMIC_YEAR), F.lit(0))).alias("raw"))
    return c.select("chunk_id", *[v.alias(k) for k, v in E.academic_year(F.col("raw")).items()])


@query(
    "e27_temporal_summary",
    f"{corpus.WITH}, r AS (SELECT doc_id, unnest(regexp_extract_all(text, {lit(E.DATE_DMY)})) AS raw FROM chunks), n AS (SELECT doc_id, regexp_extract(raw, {lit(E.DATE_DMY)}, 3) || '-' || {_P2.format(lit(E.DATE_DMY), 2)} || '-' || {_P2.format(lit(E.DATE_DMY), 1)} AS iso FROM r) "
    "SELECT doc_id, count(*) AS n_dates, min(iso) AS first_date, max(iso) AS last_date, CAST(substr(max(iso), 1, 4) AS INT) - CAST(substr(min(iso), 1, 4) AS INT) AS year_span FROM n GROUP BY 1",
)
def _(spark, sf):
    return E.temporal_summary(corpus.chunks(spark, sf), "doc_id", "text")


# Quality

_N = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
_DOC = "(SELECT doc_id, coalesce(text, '') AS text FROM documents) d"


@query(
    "q07_extraction_quality",
    f"SELECT doc_id, CASE WHEN {_N} = 0 THEN 0 ELSE greatest(0, 100 - CASE WHEN length(text) < 100 THEN 30 ELSE 0 END - CASE WHEN (length(text) - length(replace(text, chr(10), ''))) / length(text) > 0.1 THEN 10 ELSE 0 END "
    f"- CASE WHEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: length(w) = 1)) / {_N} > 0.3 THEN 20 ELSE 0 END - CASE WHEN length(regexp_replace(text, '[ \\t\\n\\r\\f]+', '', 'g')) / {_N} < 2 THEN 15 ELSE 0 END) END AS score FROM {_DOC}",
)
def _(spark, sf):
    return corpus.table(spark, sf, "documents").select("doc_id", Q.extraction_score(F.col("text")).alias("score"))


def _min_length(case: str) -> str:
    return "CASE " + " ".join(f"WHEN {case} = {lit(k)} THEN {v['min_text_length']}" for k, v in Q.THRESHOLDS.items()) + f" ELSE {Q.THRESHOLDS['unknown']['min_text_length']} END"


_TQ = (
    f"greatest(0, 100 - CASE WHEN length(text) < {_min_length('doc_type')} THEN 30 WHEN length(text) < 1.5 * {_min_length('doc_type')} THEN 15 ELSE 0 END"
    + "".join(f" - CASE WHEN {has('text', p)} THEN 10 ELSE 0 END" for p in Q.ARTIFACTS)
    + f" - CASE WHEN {_N} > 0 AND length(text) / {_N} > 15 THEN 15 ELSE 0 END)"
)


@query("q08_text_quality", f"{corpus.WITH} SELECT chunk_id, {_TQ} AS score FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", Q.text_score(F.col("text"), F.col("doc_type")).alias("score"))


@query(
    "q12_overall_quality",
    f"{corpus.WITH}, s AS (SELECT chunk_id, doc_type, {_TQ} AS tq, CASE WHEN doc_type IN ('data_report', 'framework') THEN 70 ELSE 50 END AS rq, CASE WHEN length(title) < 10 THEN 90 ELSE 100 END AS mq FROM chunks), o AS (SELECT chunk_id, round(0.25 * tq + 0.35 * 0 + 0.20 * rq + 0.20 * mq, 1) AS overall FROM s) "
    "SELECT chunk_id, overall, CASE WHEN overall BETWEEN 85 AND 100 THEN 'excellent' WHEN overall BETWEEN 70 AND 84 THEN 'good' WHEN overall BETWEEN 50 AND 69 THEN 'acceptable' WHEN overall BETWEEN 30 AND 49 THEN 'poor' WHEN overall BETWEEN 0 AND 29 THEN 'critical' ELSE 'unknown' END AS level FROM o",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    kind = F.col("doc_type")
    relations = Q.relation_score(F.lit(0), F.lit(0), F.when(kind.isin("data_report", "framework"), kind).otherwise("act"))
    meta = Q.metadata_score(F.col("chunk_id").cast("string"), kind, F.col("title"), F.lit("x"), F.lit("x"), F.lit("x"))
    overall = Q.overall(Q.text_score(F.col("text"), kind), F.lit(0), relations, meta)
    return c.select("chunk_id", overall.alias("overall")).withColumn("level", Q.level(F.col("overall")))


@query(
    "q09_entity_quality",
    f"{corpus.WITH}, c AS (SELECT chunk_id, doc_type, length(text) AS n, {' , '.join(f'len(list_distinct({" || ".join(f"regexp_extract_all(text, {lit(p)})" for p in pats)})) AS {k}' for k, pats in E.SIMPLE.items() if k in ('legal_refs', 'metrics', 'acronyms'))} FROM chunks), "
    "t AS (SELECT *, legal_refs + metrics + acronyms AS total, (CASE WHEN legal_refs > 0 THEN 1 ELSE 0 END) + (CASE WHEN metrics > 0 THEN 1 ELSE 0 END) + (CASE WHEN acronyms > 0 THEN 1 ELSE 0 END) AS cats, CASE WHEN doc_type = 'act' THEN 5 WHEN doc_type = 'government_order' THEN 3 WHEN doc_type = 'framework' THEN 8 WHEN doc_type = 'data_report' THEN 10 ELSE 2 END AS need FROM c), "
    "d AS (SELECT *, total / greatest(1, floor(n / 5)) * 100 AS density FROM t) "
    "SELECT chunk_id, round(density, 2) AS density, CASE WHEN total = 0 THEN 0 ELSE greatest(0, 100 - CASE WHEN density < need THEN least(30, floor((need - density) / need * 30)) WHEN density < 1.5 * need THEN 10 ELSE 0 END - CASE WHEN doc_type = 'act' AND legal_refs < 5 THEN 15 WHEN doc_type = 'data_report' AND metrics < 5 THEN 20 WHEN doc_type = 'government_order' THEN 20 ELSE 0 END - CASE WHEN cats < 3 THEN 15 ELSE 0 END) END::INT AS score FROM d",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf).withColumns({k: F.size(E.matches(F.col("text"), E.SIMPLE[k])) for k in ("legal_refs", "metrics", "acronyms")})
    return c.select("chunk_id", *[v.alias(k) for k, v in Q.entity_score({"legal_refs": F.col("legal_refs"), "metrics": F.col("metrics"), "acronyms": F.col("acronyms")}, F.col("doc_type"), F.length("text")).items()])


# Duplicates


@query("u01_content_hash", f"SELECT doc_id, md5({_CMP}) AS hash FROM documents")
def _(spark, sf):
    return corpus.table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("u02_exact_duplicates", f"SELECT md5({_CMP}) AS hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return U.duplicate_groups(corpus.table(spark, sf, "documents"), T.content_hash(F.col("text")), "doc_id")


@query("u03_title_duplicates", f"{corpus.WITH} SELECT md5({rewrite('lower(title)', T.COMPARE_RULES)}) AS hash, count(*) AS n, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM chunks GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return U.duplicate_groups(corpus.chunks(spark, sf), T.content_hash(F.col("title")), "chunk_id")


_SH = "CASE WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) END"


@query("u04_char_shingles", f"{corpus.WITH}, n AS (SELECT chunk_id, {rewrite('lower(text)', T.COMPARE_RULES)} AS t FROM chunks) SELECT chunk_id, len({_SH}) AS n_shingles FROM n")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.size(T.char_shingles(F.col("text"))).alias("n_shingles"))


@query(
    "u05_jaccard",
    f"{corpus.WITH}, n AS (SELECT chunk_id, doc_id, pos, {rewrite('lower(text)', T.COMPARE_RULES)} AS t FROM chunks), s AS (SELECT *, {_SH} AS sh FROM n) "
    "SELECT a.chunk_id AS a, b.chunk_id AS b, round(len(list_intersect(a.sh, b.sh)) / len(list_distinct(a.sh || b.sh)), 6) AS jaccard FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.pos < b.pos",
)
def _(spark, sf):
    c = corpus.chunks_by_document(spark, sf)
    j = set_join.pairs_in_groups(c.select(F.col("doc_id").alias("group"), F.col("chunk_id").alias("id"), "pos", T.for_comparison(F.col("text")).alias("norm")))
    return j.select("a", "b", F.round(F.col("common") / F.col("total"), 6).alias("jaccard"))


@query(
    "u07_near_duplicates",
    f"WITH n AS (SELECT min(doc_id) AS id, {_CMP} AS t FROM documents GROUP BY 2), s AS (SELECT id, {_SH} AS sh FROM n), k AS (SELECT id, sh, len(sh) AS k FROM s), "
    "p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.sh, b.sh)) AS common, a.k + b.k AS k FROM k a JOIN k b ON a.id < b.id AND least(a.k, b.k) >= 0.85 * greatest(a.k, b.k)) SELECT a, b, round(common / (k - common), 6) AS jaccard FROM p WHERE common >= 0.85 * (k - common)",
)
def _(spark, sf):
    return U.near_duplicates(corpus.table(spark, sf, "documents"), "doc_id", "text", 0.85)


@query("u06_sequence_ratio")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    return c.select("chunk_id", U.sequence_ratio(F.col("text"), F.col("title")).alias("ratio"))


@query(
    "u08_amended_version",
    f"{corpus.WITH} SELECT a.chunk_id AS a, b.chunk_id AS b, {' OR '.join(has('lower(a.title || chr(32) || b.title)', p) for p in U.AMENDED_TITLE)} OR {' OR '.join(has('lower(a.text || chr(32) || b.text)', p) for p in U.AMENDED_TEXT)} AS amended FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.pos + 1 = b.pos",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.pos") + 1 == F.col("b.pos")))
    return j.select(F.col("a.chunk_id").alias("a"), F.col("b.chunk_id").alias("b"), U.is_amended(F.col("a.text"), F.col("b.text"), F.col("a.title"), F.col("b.title")).alias("amended"))


for _strategy, _order in (("keep_latest", "y DESC, chunk_id"), ("keep_longest", "length(text) DESC, chunk_id"), ("keep_first", "chunk_id")):

    def _resolve(spark, sf, strategy=_strategy):
        return U.resolve(corpus.chunks(spark, sf), ["doc_id"], "chunk_id", strategy, year="y").select("doc_id", "chunk_id")

    QUERIES[f"u09_resolve_{_strategy}"] = (_resolve, f"{corpus.WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_order}) AS rn FROM chunks) SELECT doc_id, chunk_id FROM r WHERE rn = 1")


@query(
    "u10_year_from_text",
    f"{corpus.WITH} SELECT chunk_id, coalesce(list_max(list_filter(list_transform(regexp_extract_all(text, {lit(U.YEAR)}), lambda v: CAST(v AS INT)), lambda v: v BETWEEN 1900 AND 2030)), 0) AS year FROM chunks",
)
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", U.year_of(F.col("text")).alias("year"))


@query(
    "u11_duplicate_report",
    f"WITH h AS (SELECT doc_id, md5({_CMP}) AS hash FROM documents), g AS (SELECT hash, count(*) AS n FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS total_documents, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_documents, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS duplicate_ratio FROM g",
)
def _(spark, sf):
    return U.duplicate_report(corpus.table(spark, sf, "documents"))


@query("u12_prefix_dedup", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(substr(coalesce(text, ''), 1, 500)) ORDER BY doc_id) AS rn FROM documents) SELECT doc_id FROM r WHERE rn = 1")
def _(spark, sf):
    return U.prefix_dedup(corpus.table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@query(
    "u13_word_jaccard",
    f"{corpus.WITH} SELECT chunk_id, round(len(list_intersect({_SET.format('text')}, {_SET.format('title')})) / len(list_distinct({_SET.format('text')} || {_SET.format('title')})), 6) AS jaccard FROM chunks",
)
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.round(T.word_jaccard(F.col("text"), F.col("title")), 6).alias("jaccard"))


@query("u16_fuzzy_district", "SELECT c_custkey, levenshtein(lower(CASE WHEN c_custkey % 2 = 0 THEN 'Gunturr' ELSE 'Kurnol' END), lower(d)) AS distance, d AS district FROM customer, (SELECT unnest(['Guntur', 'Kurnool', 'Krishna']) AS d) x WHERE levenshtein(lower(CASE WHEN c_custkey % 2 = 0 THEN 'Gunturr' ELSE 'Kurnol' END), lower(d)) <= 2")
def _(spark, sf):
    c = corpus.table(spark, sf, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Gunturr' ELSE 'Kurnol' END").alias("name"))
    return U.fuzzy_names(c, "name", ["Guntur", "Kurnool", "Krishna"], 2).select("c_custkey", "distance", F.col("match").alias("district"))
