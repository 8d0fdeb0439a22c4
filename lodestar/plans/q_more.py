"""Further queries: chunkers, gates, agent ranks, answer checks, scheme and case databases, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import extract as E
from ..functions import quality as Q
from ..operators import aggregates as A
from ..operators import chunking as H
from ..operators import evidence as V
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import understanding as N
from ..sources import io
from . import corpus
from .duck import count, has, lit

QUERIES: dict = {}
W = corpus.WITH


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("k04_report_chapters", f"{W}, m AS (SELECT chunk_id, text, regexp_extract_all(text, {lit(H.CHAPTER_HEADING)}) AS h FROM chunks) SELECT chunk_id, 0 AS position, coalesce(h[1], 'Full Document') AS title, CASE WHEN len(h) > 0 THEN trim(substr(text, length(h[1]) + 2)) ELSE text END AS text FROM m")
def _(spark, sf):
    return H.report_chapters(corpus.chunks(spark, sf), "chunk_id", "text")


@query("k13_legal_sections", f"{W}, m AS (SELECT chunk_id, unnest(CASE WHEN regexp_matches(text, {lit(H.LEGAL_HEADING)}) THEN regexp_extract_all(text, {lit(H.LEGAL_HEADING)}) ELSE ['Full Document'] END) AS title FROM chunks) SELECT chunk_id, trim(title) AS title, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, sf):
    s = H.titled_sections(corpus.chunks(spark, sf), "chunk_id", "text", H.LEGAL_HEADING)
    return s.groupBy("chunk_id", "title").agg(F.count("*").alias("n"))


_SUB = "'Duties' || chr(10) || '(a) first ' || CAST(n1 AS STRING) || chr(10) || '(b) second' || chr(10) || '(12) third'"


@query("k14_subsections", f"{W} SELECT chunk_id, unnest(list_transform(regexp_extract_all({_SUB}, {lit(H.SUBSECTION)}), lambda x: trim(x, ' ' || chr(10)))) AS subsection FROM chunks")
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", F.explode(H.subsections(F.expr(_SUB))).alias("s"))
    return c.select("chunk_id", F.regexp_replace("s", r"^\s+|\s+$", "").alias("subsection"))


@query("k16_holdings", f"{W} SELECT chunk_id, unnest(list_filter(list_transform(regexp_extract_all(text, {lit(H.HOLDING)}), lambda x: trim(x)), lambda x: length(x) > 30)) AS holding FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.explode(H.holdings(F.col("text"), 30)).alias("holding"))


@query("k17_table_runs", f"{W}, l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM chunks), m AS (SELECT *, line_no - row_number() OVER (PARTITION BY chunk_id ORDER BY line_no) AS i FROM l WHERE regexp_matches(line, '\\d.*\\s.*\\d')) SELECT chunk_id, min(line_no) AS first_line, count(*)::INT AS n_lines FROM m GROUP BY chunk_id, i")
def _(spark, sf):
    return H.table_runs(corpus.chunks(spark, sf), "chunk_id", "text")


@query("k22_cross_references", f"{W} SELECT chunk_id, unnest(list_distinct({' || '.join(f'regexp_extract_all(text, {lit(p)}, 1)' for p in H.REFERENCES)})) AS ref FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.explode(H.cross_references(F.col("text"))).alias("ref"))


_T = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_TYPE7 = "CASE WHEN regexp_matches(doc_type, 'act|rule|legal') THEN 'legal' WHEN regexp_matches(doc_type, 'order|go') THEN 'order' WHEN regexp_matches(doc_type, 'judicial|case') THEN 'judicial' WHEN regexp_matches(doc_type, 'data|report') THEN 'data' ELSE 'general' END"


@query(
    "k07_chunk_documents",
    f"{W.replace('WITH', 'WITH RECURSIVE', 1)}, t AS (SELECT chunk_id, text, {_TYPE7} AS type FROM chunks), "
    "p AS (SELECT chunk_id, type, CASE WHEN type = 'order' THEN list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') ELSE list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS parts, CASE type WHEN 'order' THEN chr(10) ELSE chr(10) || chr(10) END AS glue FROM t), "
    "f(chunk_id, type, parts, glue, i, now, k) AS (SELECT chunk_id, type, parts, glue, 2, parts[1], 0 FROM p WHERE len(parts) > 0 UNION ALL SELECT chunk_id, type, parts, glue, i + 1, CASE WHEN length(now) + length(parts[i]) <= 200 THEN now || glue || parts[i] WHEN type = 'order' THEN parts[i] ELSE right(now, 20) || glue || parts[i] END, k + CASE WHEN length(now) + length(parts[i]) > 200 THEN 1 ELSE 0 END FROM f WHERE i <= len(parts)), "
    "g AS (SELECT chunk_id, type, k, arg_max(now, i) AS text FROM f GROUP BY 1, 2, 3), "
    f"o AS (SELECT chunk_id, type, CASE type WHEN 'legal' THEN list_transform(range(1, len(regexp_extract_all(text, {lit(H.LEGAL_HEADING)})) + 1), lambda j: trim(regexp_extract_all(text, {lit(H.LEGAL_HEADING)})[j]) || chr(10) || {_T.format(f'string_split_regex(text, {lit(H.LEGAL_HEADING)})[j + 1]')}) "
    f"WHEN 'judicial' THEN list_concat(list_slice(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> ''), 1, 3), list_filter(list_transform(regexp_extract_all(text, {lit(H.HOLDING)}), lambda x: trim(x)), lambda x: length(x) > 50)) "
    f"WHEN 'data' THEN list_transform(regexp_extract_all(text, {lit(H.SUMMARY)}), lambda x: trim(x)) ELSE [] END AS own, len(list_slice(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> ''), 1, 3)) AS n_facts FROM t) "
    "SELECT chunk_id, generate_subscripts(own, 1)::INT - 1 AS chunk_no, CASE type WHEN 'legal' THEN 'legal_section' WHEN 'data' THEN 'data_summary' ELSE CASE WHEN generate_subscripts(own, 1) <= n_facts THEN 'judicial_fact' ELSE 'judicial_holding' END END AS chunk_type, unnest(own) AS text FROM o WHERE len(own) > 0 "
    "UNION ALL SELECT chunk_id, k::INT, CASE type WHEN 'order' THEN 'go_order' ELSE 'general_paragraph' END, text FROM g WHERE chunk_id IN (SELECT chunk_id FROM o WHERE len(own) = 0)",
)
def _(spark, sf):
    return H.chunk_documents(corpus.chunks(spark, sf), "chunk_id", "text", "doc_type", 200, 20)


@query("k18_enriched_chunks", f"{W} SELECT chunk_id, instr(text, substr(text, 1, 40)) - 1 AS start, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) AS sentence_count FROM chunks")
def _(spark, sf):
    of = H.enrich(F.col("text"), prefix=40)
    return corpus.chunks(spark, sf).select("chunk_id", *[v.alias(k) for k, v in of.items()])


@query("e28_context_window", f"{W} SELECT chunk_id, trim(substr(text, greatest(strpos(text, 'Section') - 20, 1), strpos(text, 'Section') + 6 + 20 - greatest(strpos(text, 'Section') - 20, 1) + 1), ' ' || chr(10)) AS context FROM chunks WHERE contains(text, 'Section')")
def _(spark, sf):
    c = corpus.chunks(spark, sf).where(F.col("text").contains("Section"))
    at = F.instr("text", "Section") - 1
    return c.select("chunk_id", V.context(F.col("text"), at, at + 7, 20).alias("context"))


@query("e26_date_dedup", f"{W}, r AS (SELECT chunk_id, unnest(regexp_extract_all(text, {lit(E.DATE_DMY)})) AS raw, text FROM chunks), p AS (SELECT chunk_id, raw, floor((strpos(text, raw) - 1) / 10) AS bucket FROM r) SELECT DISTINCT chunk_id, raw, bucket::BIGINT AS bucket FROM p")
def _(spark, sf):
    r = corpus.chunks(spark, sf).select("chunk_id", "text", F.explode(F.regexp_extract_all("text", F.lit(E.DATE_DMY), F.lit(0))).alias("raw"))
    return r.select("chunk_id", "raw", F.floor((F.expr("instr(text, raw)") - 1) / 10).alias("bucket")).distinct()


@query("e29_metric_pairs", f"{W} SELECT chunk_id, unnest(list_slice(regexp_extract_all(text, '([A-Za-z ]+ (?:rate|ratio|percentage)) (?:was|is|rose)', 1), 1, 20)) AS name FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.explode(V.metric_pairs(F.col("text"))).alias("name"))


@query("e20_query_entities", f"WITH q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'PTR in Guntur for 2023-24' WHEN 1 THEN 'Amma Vodi in Krishna and Section 12' ELSE 'dropout rate in Kurnool' END AS text FROM customer) SELECT c_custkey, kind, lower(v) AS value FROM (SELECT c_custkey, 'district' AS kind, unnest(regexp_extract_all(text, {lit(E.SIMPLE['districts'][0])})) AS v FROM q UNION ALL SELECT c_custkey, 'scheme', unnest(regexp_extract_all(text, {lit(E.SIMPLE['schemes'][0])})) FROM q UNION ALL SELECT c_custkey, 'legal', unnest(regexp_extract_all(text, {lit(E.SIMPLE['legal_refs'][0])})) FROM q UNION ALL SELECT c_custkey, 'year', unnest(regexp_extract_all(text, '\\b\\d{{4}}-\\d{{2}}\\b')) FROM q) x")
def _(spark, sf):
    q = corpus.table(spark, sf, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'PTR in Guntur for 2023-24' WHEN 1 THEN 'Amma Vodi in Krishna and Section 12' ELSE 'dropout rate in Kurnool' END").alias("text"))

    def found(kind, pattern):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("value")))

    rows = F.concat(found("district", E.SIMPLE["districts"][0]), found("scheme", E.SIMPLE["schemes"][0]), found("legal", E.SIMPLE["legal_refs"][0]), found("year", r"\b\d{4}-\d{2}\b"))
    return q.select("c_custkey", F.explode(rows).alias("e")).select("c_custkey", "e.*")


# The score of these texts by the rules that apply to plain lines: short ones lose 30.
@query("f12_ingestion_gate", "SELECT c_custkey, 100 - CASE WHEN length(t) < 100 THEN 30 ELSE 0 END >= 80 AS passes FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'too short' ELSE 'A plain paragraph of ordinary words that is long enough to count as a text, without any odd signs at all, for customer number ' || CAST(c_custkey AS STRING) END AS t FROM customer) x")
def _(spark, sf):
    t = F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'too short' ELSE 'A plain paragraph of ordinary words that is long enough to count as a text, without any odd signs at all, for customer number ' || CAST(c_custkey AS STRING) END")
    return corpus.table(spark, sf, "customer").select("c_custkey", Q.passes_gate(Q.extraction_score(t), 80).alias("passes"))


@query("f06_relations_of_document", f"{W}, r AS (SELECT 'doc_' || CAST(doc_id AS STRING) || '_chunk_' || CAST(pos AS STRING) AS rid FROM chunks) SELECT o_orderkey AS doc_id, count(*) AS n FROM orders JOIN r ON regexp_extract(rid, '^doc_(\\d+)_', 1) = CAST(o_orderkey AS STRING) GROUP BY 1")
def _(spark, sf):
    r = corpus.chunks(spark, sf).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("pos").cast("string")).alias("rid"))
    d = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return G.relations_of_document(r, d, "rid", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


_GO = (("government order", 0.2), ("g.o.", 0.2), ("circular", 0.1), ("supersession", 0.1), ("supersedes", 0.1))


@query("r21_order_rank", f"{W}, s AS (SELECT chunk_id, 0.7 * v / 900.0 + 0.3 * least(1.0, {' + '.join(f'CASE WHEN contains(lower(text), {lit(k)}) THEN {w} ELSE 0 END' for k, w in _GO)} + CASE WHEN 2018 - y <= 1 THEN 0.15 WHEN 2018 - y <= 3 THEN 0.1 WHEN 2018 - y <= 5 THEN 0.05 ELSE 0 END) AS c FROM chunks) SELECT chunk_id, round(c, 6) AS combined FROM s")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.round(R.order_rank(F.col("text"), F.col("v") / 900, F.col("y"), 2018), 6).alias("combined"))


@query("r25_retrieval_confidence", f"{W}, r AS (SELECT n1, v / 900.0 AS s, row_number() OVER (PARTITION BY n1 ORDER BY v DESC, chunk_id) AS rn FROM chunks) SELECT n1, round(0.7 * avg(s) + 0.3 * 0.5, 6) AS confidence FROM r WHERE rn <= 3 GROUP BY 1")
def _(spark, sf):
    t = R.top_per_group(corpus.chunks(spark, sf), "n1", 3, "v", "chunk_id")
    return t.groupBy("n1").agg(F.round(0.7 * F.avg(F.col("v") / 900) + 0.15, 6).alias("confidence"))


_AUTH = "CASE doc_type WHEN 'act' THEN 1.0 WHEN 'rule' THEN 0.9 WHEN 'government_order' THEN 0.8 WHEN 'judicial' THEN 0.7 ELSE 0.5 END"


@query("r31_cross_validation", f"{W}, c AS (SELECT doc_id, avg({_AUTH}) AS authority, avg(v / 900.0) AS relevance, max(CASE WHEN {has('text', '(?i)shall|must')} THEN 1 ELSE 0 END) AS strict, max(CASE WHEN {has('text', '(?i)may|should')} THEN 1 ELSE 0 END) AS loose FROM chunks GROUP BY 1) SELECT doc_id, round(0.4 * relevance + 0.4 * authority + 0.2 * CASE WHEN strict = 1 AND loose = 1 THEN 0.5 ELSE 1.0 END, 6) AS calibrated FROM c")
def _(spark, sf):
    return R.cross_validation(corpus.chunks(spark, sf), "doc_id", "text", "doc_type", F.col("v") / 900)


@query("q01_keyword_score", f"{W} SELECT chunk_id, {count('lower(text)', 'section')} * 2.0 + CASE WHEN contains(lower(text), 'order') THEN 1.0 ELSE 0 END AS score FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", N.keyword_score(F.col("text"), ["order"], ["section"]).alias("score"))


@query("q10_relation_quality", f"{W}, r AS (SELECT chunk_id, doc_type, {count('text', E.RELATIONS[0][2])} + {count('text', E.RELATIONS[5][2])} AS n, CASE WHEN {count('text', E.RELATIONS[0][2])} > 0 THEN 1 ELSE 0 END + CASE WHEN {count('text', E.RELATIONS[5][2])} > 0 THEN 1 ELSE 0 END AS k FROM chunks) SELECT chunk_id, CASE WHEN doc_type IN ('data_report', 'framework') THEN CASE WHEN n = 0 THEN 70 ELSE 100 END ELSE CASE WHEN doc_type IN ('act', 'rule', 'government_order', 'case_law') THEN CASE WHEN n = 0 THEN 50 WHEN n < 3 THEN 70 ELSE 100 END ELSE 100 END - CASE WHEN n > 0 AND k < 2 THEN 10 ELSE 0 END END AS score FROM r")
def _(spark, sf):
    a, b = F.regexp_count("text", F.lit(E.RELATIONS[0][2])), F.regexp_count("text", F.lit(E.RELATIONS[5][2]))
    return corpus.chunks(spark, sf).select("chunk_id", Q.relation_score(a + b, (a > 0).cast("int") + (b > 0).cast("int"), F.col("doc_type")).alias("score"))


@query("q11_metadata_quality", f"{W} SELECT chunk_id, greatest(0, 100 - CASE WHEN y < 2014 THEN 5 ELSE 0 END - 5 - CASE WHEN length(title) < 10 THEN 10 ELSE 0 END) AS score FROM chunks")
def _(spark, sf):
    m = Q.metadata_score(F.col("chunk_id").cast("string"), F.col("doc_type"), F.col("title"), F.when(F.col("y") >= 2014, F.col("y")), F.lit(None).cast("string"), F.lit("x"))
    return corpus.chunks(spark, sf).select("chunk_id", m.alias("score"))


@query("a17_rule_hierarchy", f"{W}, r AS (SELECT DISTINCT title, unnest(regexp_extract_all(text, '(?i)Rule\\s+(\\d+)', 1)) AS rule FROM chunks) SELECT title, count(*) AS n_rules, min(CAST(rule AS INT)) AS first_rule, max(CAST(rule AS INT)) AS last_rule FROM r GROUP BY 1")
def _(spark, sf):
    return A.rule_hierarchy(corpus.chunks(spark, sf), "title", "text")


_SUBJECTS = ("court", "school", "budget", "enrollment", "scheme")


@query("a19_subject_index", f"{W}, s AS (SELECT chunk_id, unnest(list_filter({list(_SUBJECTS)!r}, lambda k: contains(lower(text), k))) AS subject FROM chunks) SELECT subject, count(*) AS n, min(chunk_id) AS first_chunk FROM s GROUP BY 1")
def _(spark, sf):
    return A.subject_index(corpus.chunks(spark, sf), "chunk_id", "text", _SUBJECTS)


@query("a24_topic_chunks", f"{W}, r AS (SELECT doc_type, chunk_id, row_number() OVER (PARTITION BY doc_type ORDER BY v DESC, chunk_id) AS rank FROM chunks) SELECT doc_type, string_agg(CAST(chunk_id AS STRING), ',' ORDER BY rank) AS chunk_ids FROM r WHERE rank <= 20 GROUP BY 1")
def _(spark, sf):
    return A.topic_chunks(corpus.chunks(spark, sf), "doc_type", "chunk_id", "v")


@query("x01_scheme_database", f"{W}, s AS (SELECT chunk_id, y, unnest(list_distinct(list_transform(regexp_extract_all(text, {lit(E.SIMPLE['schemes'][0])}), lambda x: lower(x)))) AS scheme FROM chunks) SELECT scheme, count(*) AS n, min(y) AS first_year, arg_min(y, chunk_id) AS entry_year FROM s GROUP BY 1")
def _(spark, sf):
    s = corpus.chunks(spark, sf).select("chunk_id", "y", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(E.SIMPLE["schemes"][0]), F.lit(0)), lambda x: F.lower(x)))).alias("scheme"))
    return s.groupBy("scheme").agg(F.count("*").alias("n"), F.min("y").alias("first_year"), F.min_by("y", "chunk_id").alias("entry_year"))


@query("x14_order_chain_from_pairs", "WITH p AS (SELECT o_orderkey AS a, CAST(floor(o_orderkey / 3) AS BIGINT) AS b FROM orders), e AS (SELECT a AS node, b AS other FROM p UNION ALL SELECT b, a FROM p) SELECT node, count(*) AS n, min(other) AS least, max(other) AS most FROM e GROUP BY 1")
def _(spark, sf):
    p = corpus.table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.floor(F.col("o_orderkey") / 3).alias("b"))
    return G.neighbours(p).groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("least"), F.max("other").alias("most"))


@query("x29_order_ids", f"{W} SELECT chunk_id, 'GO_' || CAST(n1 AS STRING) || '_' || CAST(y AS STRING) AS order_id FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", G.order_id(F.col("n1"), F.col("y")).alias("order_id"))


@query("s17_json_export", f"{W} SELECT chunk_id, '{{\"chunk_id\":' || CAST(chunk_id AS STRING) || ',\"doc_type\":\"' || doc_type || '\"}}' AS value FROM chunks")
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", "doc_type")
    return c.select("chunk_id", F.to_json(F.struct("chunk_id", "doc_type")).alias("value"))


@query("s22_vertical_of_path", f"{W}, p AS (SELECT chunk_id, lower(title) AS f, lower(doc_type) AS d FROM chunks), s AS (SELECT chunk_id, CASE WHEN contains(f, 'act') THEN 2 ELSE 0 END + CASE WHEN contains(d, 'act') THEN 3 ELSE 0 END AS legal, CASE WHEN contains(f, 'order') OR contains(f, 'g.o') THEN 2 ELSE 0 END + CASE WHEN contains(d, 'order') THEN 3 ELSE 0 END AS orders, CASE WHEN contains(f, 'data') THEN 2 ELSE 0 END + CASE WHEN contains(d, 'data') THEN 3 ELSE 0 END AS data FROM p) SELECT chunk_id, CASE WHEN greatest(legal, orders, data) = 0 THEN 'other' WHEN legal = greatest(legal, orders, data) THEN 'legal' WHEN orders = greatest(legal, orders, data) THEN 'orders' ELSE 'data' END AS vertical FROM s")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", C.vertical_of(F.col("title"), F.col("doc_type")).alias("vertical"))


@query("n06_context_expansion", f"{W} SELECT chunk_id, title || ' in ' || district AS text, 0.85::DOUBLE AS weight FROM (SELECT chunk_id, title, CASE WHEN contains(text, 'Guntur') THEN 'Guntur' WHEN contains(text, 'Krishna') THEN 'Krishna' WHEN contains(text, 'Kurnool') THEN 'Kurnool' END AS district FROM chunks) d WHERE district IS NOT NULL")
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", "title", A.first_district(F.col("text")).alias("district")).where("district is not null")
    return c.select("chunk_id", F.concat_ws(" in ", "title", "district").alias("text"), F.lit(0.85).alias("weight"))


@query("n07_validator", f"{W} SELECT chunk_id, CASE WHEN kind NOT IN (2, 3) THEN 'missing' WHEN y BETWEEN 2010 AND 2016 THEN 'valid' ELSE 'out_of_range' END AS verdict FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", N.year_verdict(F.col("text"), 2010, 2016).alias("verdict"))


@query("u15_merge_results", "WITH a AS (SELECT vec_id AS doc_id, 1 AS src FROM embeddings UNION ALL SELECT doc_id, 2 FROM documents) SELECT doc_id, min(src) AS src FROM a WHERE doc_id IS NOT NULL GROUP BY 1")
def _(spark, sf):
    v = corpus.table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("doc_id"))
    return R.merge_results([v, corpus.table(spark, sf, "documents").select("doc_id")], "doc_id")


@query("s16_corpus_index", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars IS NOT NULL")
def _(spark, sf):
    return io.latest(corpus.table(spark, sf, "documents").where("n_chars is not null"), "doc_id", "n_chars").select("doc_id", "lang", "source", "n_chars")
