"""Queries of evidence, agents, topic tables and the chunkers of each type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dictionaries as D
from ..functions import extract as E
from ..operators import agents as X
from ..operators import chunking as H
from ..operators import evidence as V
from ..operators import graph as G
from ..operators import understanding as N
from . import corpus
from .duck import lit
from .q_graph import _CHAIN, _CW, _W, _chain, _edges, _nodes
from .q_query import _TOP

QUERIES: dict = {}
W = corpus.WITH


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


# Dictionaries: every entry occurs; the SQL knows which entry was put in and compares strings, not patterns.

_DICTIONARIES = {"schemes": D.SCHEMES, "districts": D.DISTRICTS, "social_categories": D.SOCIAL_CATEGORIES, "school_types": D.SCHOOL_TYPES, "education_levels": D.EDUCATION_LEVELS}


def _entry(names) -> str:
    return f"element_at(array({', '.join(map(lit, names))}), CAST(o_orderkey % {len(names)} AS INT) + 1)"


def _first_of(kind: str, names) -> str:
    all_ = f"[{', '.join(map(lit, names))}]"
    fits = f"list_filter({all_}, lambda x: starts_with(lower(e), lower(x)) AND NOT regexp_matches(substr(e, length(x) + 1, 1), '[A-Za-z0-9_]'))"
    return f"SELECT o_orderkey, {lit(kind)} AS kind, substr(e, 1, length({fits}[1])) AS name FROM (SELECT o_orderkey, {all_}[o_orderkey % {len(names)} + 1] AS e FROM orders) x"


@query("e03_dictionary_names", " UNION ALL ".join(_first_of(k, v) for k, v in _DICTIONARIES.items()))
def _(spark, sf):
    o = corpus.spread(corpus.table(spark, sf, "orders").select("o_orderkey"))
    text = {k: F.expr(f"concat('-- ', {_entry(v)}, ', as noted')") for k, v in _DICTIONARIES.items()}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.get(E.matches(t, E.SIMPLE[k]), F.lit(0)).alias("name")) for k, t in text.items()])
    return o.select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*")


# Matches with place and context

_TRIM = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


def _found(rules, window: int = 50) -> str:
    """A common table expression f(chunk_id, kind, value, confidence, start, stop, context, text) of the rules' matches."""
    each = " UNION ALL ".join(
        f"SELECT chunk_id, text, {lit(k)} AS kind, CAST({c} AS DOUBLE) AS confidence, regexp_extract_all(text, {lit(p)}) AS w, regexp_extract_all(text, {lit(p)}, {g}) AS v, string_split_regex(text, {lit(p)}) AS s FROM chunks" for k, c, p, g in rules
    )
    length = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
    lo = f"greatest(start - {window}, 0)"
    return (
        f"m AS ({each}), i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m), p AS (SELECT *, ({length('s[1:i]')} + {length('w[1:i-1]')})::INT AS start FROM i), "
        f"f AS (SELECT chunk_id, kind, trim(v[i]) AS value, confidence, start, (start + length(w[i]))::INT AS stop, {_TRIM.format(f'substr(text, {lo} + 1, start + length(w[i]) + {window} - {lo})')} AS context, text FROM p)"
    )


_OUT = "chunk_id, kind, value, confidence, start, stop, context"


def _places(rows):
    return rows.select("chunk_id", "kind", "value", "confidence", "start", F.col("end").alias("stop"), "context")


_ENT = (*V.ENTITIES, ("scheme", 0.95, D.any_of(D.SCHEMES), 0), *(("metric", 0.9, p, 0) for p in E.SIMPLE["metrics"]), ("district", 0.8, D.any_of(D.DISTRICTS), 0))


@query("e09_relations_in_context", f"{W}, {_found(E.RELATIONS)} SELECT {_OUT} FROM f")
def _(spark, sf):
    return _places(V.relations_in_context(corpus.chunks(spark, sf), "chunk_id", "text"))


@query("e13_entities_with_spans", f"{W}, {_found(_ENT)} SELECT {_OUT} FROM f")
def _(spark, sf):
    return _places(V.entities(corpus.chunks(spark, sf), "chunk_id", "text"))


@query("e14_relations_with_evidence", f"{W}, {_found(V.RELATIONS)} SELECT {_OUT} FROM f")
def _(spark, sf):
    return _places(V.relations(corpus.chunks(spark, sf), "chunk_id", "text"))


_BRIDGE = {"access": ("enrollment", "amma vodi", "students"), "staffing": ("pupil-teacher ratio", "teacher"), "law": ("section", "court", "act")}
_HITS = "[" + ", ".join(f"CASE WHEN {' + '.join(f'(CASE WHEN contains(lower(text), {lit(w)}) THEN 1 ELSE 0 END + CASE WHEN list_contains(vals, {lit(w)}) THEN 1 ELSE 0 END)' for w in ws)} >= 2 THEN {lit(t)} END" for t, ws in _BRIDGE.items()) + "]"
_ANALYSIS = (
    f"{W}, {_found(_ENT)}, e AS (SELECT chunk_id, count(*) AS n, list(lower(value)) AS vals FROM f GROUP BY 1), {_found(V.RELATIONS).replace('m AS', 'm2 AS').replace('FROM m)', 'FROM m2)').replace(', i AS', ', i2 AS').replace('FROM i)', 'FROM i2)').replace(', p AS', ', p2 AS').replace('FROM p)', 'FROM p2)').replace('f AS (SELECT chunk_id', 'f2 AS (SELECT chunk_id')}, "
    f"r AS (SELECT chunk_id, count(*) AS n FROM f2 GROUP BY 1), a AS (SELECT c.chunk_id, coalesce(e.n, 0) AS n_entities, coalesce(r.n, 0) AS n_relations, list_filter({_HITS}, lambda x: x IS NOT NULL) AS topics FROM (SELECT *, [''] AS none FROM chunks) c LEFT JOIN e USING (chunk_id) LEFT JOIN r USING (chunk_id))"
)


@query("e15_chunk_analysis", f"{_ANALYSIS} SELECT chunk_id, n_entities, n_relations, array_to_string(topics, ',') AS topics FROM a")
def _(spark, sf):
    a = V.analysis(corpus.chunks(spark, sf), "chunk_id", "text", _BRIDGE)
    return a.select("chunk_id", "n_entities", "n_relations", F.array_join("topics", ",").alias("topics"))


@query("e15b_extraction_statistics", f"{_ANALYSIS} SELECT count(*) AS n_chunks, sum(n_entities)::BIGINT AS n_entities, sum(n_relations)::BIGINT AS n_relations, count(*) FILTER (len(topics) > 0) AS n_with_topic, round(avg(n_entities), 6) AS mean_entities, round(avg(n_relations), 6) AS mean_relations FROM a")
def _(spark, sf):
    s = V.extraction_statistics(V.analysis(corpus.chunks(spark, sf), "chunk_id", "text", _BRIDGE))
    return s.select("n_chunks", "n_entities", "n_relations", "n_with_topic", F.round("mean_entities", 6).alias("mean_entities"), F.round("mean_relations", 6).alias("mean_relations"))


# Ranges and periods: the SQL knows what was written.

_LONG = f"concat('Valid from ', {_s('d')}, ' March ', {_s('y')}, ' to ', {_s('d')}, '/', {_s('m')}, '/', {_s('y + 1')}, '. Held during the period ', {_s('d')}, '/', {_s('m')}, '/', {_s('y')}, ' to ', {_s('y + 2')}, '. Figures in the years ', {_s('y')}, '-', {_s('y + 3')}, ' hold. In Q3 of ', {_s('y')}, ', the second semester ', {_s('y + 1')}, ' and the first half of ', {_s('y + 2')}, '.')"
_P2 = "lpad(CAST({} AS STRING), 2, '0')"


def _dated(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.expr(_LONG).alias("t"))


@query(
    "e25_date_ranges",
    f"{W} SELECT chunk_id, {_s('y')} || '-03-' || {_P2.format('d')} AS start_date, {_s('y + 1')} || '-' || {_P2.format('m')} || '-' || {_P2.format('d')} AS end_date FROM chunks "
    f"UNION ALL SELECT chunk_id, {_s('y')} || '-' || {_P2.format('m')} || '-' || {_P2.format('d')}, {_s('y + 2')} || '-01-01' FROM chunks UNION ALL SELECT chunk_id, {_s('y')} || '-01-01', {_s('y + 3')} || '-01-01' FROM chunks",
)
def _(spark, sf):
    return V.date_ranges(_dated(spark, sf), "chunk_id", "t").select("chunk_id", "start_date", "end_date")


@query("e25b_periods", f"{W} SELECT chunk_id, 'quarter' AS period_type, y AS year FROM chunks UNION ALL SELECT chunk_id, 'semester', y + 1 FROM chunks UNION ALL SELECT chunk_id, 'half_year', y + 2 FROM chunks")
def _(spark, sf):
    return V.periods(_dated(spark, sf), "chunk_id", "t").select("chunk_id", "period_type", "year")


@query("x09_temporal_counts", f"{W} SELECT chunk_id, 2 AS n_dates, 1 AS n_academic_years, 3 AS n_ranges, 3 AS n_periods FROM chunks")
def _(spark, sf):
    return V.temporal(_dated(spark, sf), "chunk_id", "t")


# Relationships: what the eight texts say, written out.

_REL = (
    f"rel AS (SELECT chunk_id, 'government_order_' || {_s('n1')} AS source, 'government_order_' || {_s('n2')} AS target, 'supersedes' AS relation_type, CASE kind WHEN 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM chunks WHERE kind IN (0, 7) "
    f"UNION ALL SELECT chunk_id, 'legal_section_' || {_s('n2')}, 'legal_section_' || {_s('n1')}, 'references', 0.8::DOUBLE FROM chunks WHERE kind = 1 UNION ALL SELECT chunk_id, 'legal_section_' || {_s('n2')}, 'legal_section_' || {_s('n1')}, 'cross_references', 0.8::DOUBLE FROM chunks WHERE kind = 1)"
)


@query("e17_relationships", f"{W}, {_REL} SELECT * FROM rel")
def _(spark, sf):
    return V.relationships(corpus.chunks(spark, sf), "chunk_id", "text").drop("evidence")


@query("g01_build_statistics", f"{W}, {_REL}, alle AS (SELECT relation_type, confidence FROM rel UNION ALL SELECT CASE relation_type WHEN 'supersedes' THEN 'superseded_by' ELSE 'referenced_by' END, confidence * 0.9 FROM rel WHERE relation_type IN ('supersedes', 'references')) SELECT relation_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM alle GROUP BY 1")
def _(spark, sf):
    return G.build(corpus.chunks(spark, sf), "chunk_id", "text")["edges"].groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("e08_all_entities", f"{W}, a AS (" + " UNION ALL ".join(f"SELECT chunk_id, {lit(k)} AS kind, unnest(list_distinct(list_transform({' || '.join(f'regexp_extract_all(text, {lit(p)})' for p in ps)}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS value FROM chunks" for k, ps in E.SIMPLE.items()) + ") SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM a GROUP BY 1")
def _(spark, sf):
    a = V.all_entities(corpus.chunks(spark, sf), "chunk_id", "text", orders=False)  # e01_order_references has those
    return a.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


# Agents


@query("f07_legal_filter", f"{W} SELECT chunk_id FROM chunks WHERE contains(lower(text), 'section 1') AND contains(doc_type, 'act') AND regexp_matches(text, '(?i)amend|insert|substitute|omit')")
def _(spark, sf):
    return X.legal_filter(corpus.chunks(spark, sf), "text", "doc_type", "Section 1", "ACT", True).select("chunk_id")


@query("f08_order_filter", f"{W} SELECT chunk_id FROM chunks WHERE contains(lower(text || doc_type), 'g.o.ms.no. 1') AND contains(lower(text), 'nadu-nedu') AND contains(doc_type, 'order') AND contains(text || doc_type, '2014')")
def _(spark, sf):
    return X.order_filter(corpus.chunks(spark, sf), "text", "doc_type", "G.O.Ms.No. 1", "Nadu-Nedu", "order", 2014).select("chunk_id")


_BOOST = "CASE WHEN y >= 2023 THEN 1.2 WHEN y >= 2020 THEN 1.1 WHEN y < 2015 THEN 0.9 ELSE 1.0 END * CASE WHEN doc_type IN ('act', 'rule') THEN 1.15 WHEN doc_type = 'government_order' THEN 1.1 WHEN doc_type = 'framework' THEN 0.95 ELSE 1.0 END"


@query("r14_rerank")
def _(spark, sf):
    """A greedy choice for diversity; tests hold it against a plain version."""
    from ..operators import retrieval as R

    boost = R.metadata_boost(F.col("y"), F.col("doc_type"), F.lit(None).cast("string"))
    return X.rerank(corpus.chunks(spark, sf), "kind", "chunk_id", "text", F.lit(1.0), F.round(F.col("v") / 900 * boost, 9), 10, 0.3)


_TERMS, _NAMES = ("school", "budget", "order"), ("Guntur", "Amma Vodi")
_RELATED = {"Section": (("school", 0.9), ("court", 0.5)), "Guntur": (("district", 0.8),)}
_SEM = f"least(1.0, CASE WHEN doc_type = 'act' AND ({' OR '.join(f'contains(low, {lit(w)})' for w in X.MEANING)}) THEN 0.3 WHEN doc_type <> 'act' AND ({' OR '.join(f'contains(low, {lit(w)})' for w in X.STEPS)}) THEN 0.3 ELSE 0 END + " + " + ".join([f"CASE WHEN contains(low, {lit(x.lower())}) THEN 0.2 ELSE 0 END" for x in _NAMES] + [f"CASE WHEN contains(low, {lit(x)}) THEN 0.1 ELSE 0 END" for x in _TERMS]) + ")::DOUBLE"
_RELV = "least(1.0, " + " + ".join([f"CASE WHEN contains(low, {lit(e.lower())}) THEN 0.2 ELSE 0 END" for e in _RELATED] + [f"CASE WHEN contains(low, {lit(v)}) THEN {0.1 * c} ELSE 0 END" for r in _RELATED.values() for v, c in r]) + ")::DOUBLE"
_R30 = f"{W}, r AS (SELECT doc_id, chunk_id, v / 900.0 AS score, {_SEM} AS semantic, {_RELV} AS relationship FROM (SELECT *, lower(text) AS low FROM chunks) l)"


def _relevance(spark, sf):
    intent = F.when(F.col("doc_type") == "act", "legal_interpretation").otherwise("procedural_guidance")
    return corpus.chunks(spark, sf).select("doc_id", "chunk_id", (F.col("v") / 900).alias("score"), X.semantic_relevance(F.col("text"), intent, list(_NAMES), list(_TERMS)).alias("semantic"), X.relationship_relevance(F.col("text"), _RELATED).alias("relationship"))


@query("r30_chunk_relevance", f"{_R30} SELECT chunk_id, round(semantic, 6) AS semantic, round(relationship, 6) AS relationship FROM r")
def _(spark, sf):
    return _relevance(spark, sf).select("chunk_id", F.round("semantic", 6).alias("semantic"), F.round("relationship", 6).alias("relationship"))


@query("r30b_retrieval_confidence", f"{_R30} SELECT doc_id, round(least(1.0, 0.4 * max(score) + 0.3 * avg(semantic) + 0.2 * avg(relationship) + 0.1 * least(1.0, count(*) / 10)), 6) AS confidence FROM r GROUP BY 1")
def _(spark, sf):
    return X.retrieval_confidence(_relevance(spark, sf), "doc_id", "score", "semantic", "relationship", "chunk_id").withColumn("confidence", F.round("confidence", 6))


_ENTITIES = "SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'scheme' ELSE 'government_order' END AS entity_type, value FROM nodes"


def _schemes(spark, sf):
    return _nodes(spark, sf).select("entity_id", F.when(F.col("entity_id") % 3 == 0, "scheme").otherwise("government_order").alias("entity_type"), "value")


@query("g08_implementing_documents", f"{_W}, n AS ({_ENTITIES}) SELECT DISTINCT e.source, t.entity_id, t.value FROM edges e JOIN n s ON e.source = s.entity_id AND s.entity_type = 'scheme' AND lower(s.value) = 'no 3' JOIN n t ON e.target = t.entity_id WHERE e.relation_type = 'implements'")
def _(spark, sf):
    return X.implementing_documents(_edges(spark, sf), _schemes(spark, sf), F.lit("NO 3"))


@query("g09_query_warnings", f"{_CW}, c AS (SELECT start, arg_max(node, depth) AS current, max(depth) AS n FROM chain GROUP BY 1) SELECT o_orderkey, start AS asked, current, {_s('start')} || ' was superseded by ' || {_s('current')} AS warning, (n + 1)::BIGINT AS n_chain FROM orders JOIN c ON o_orderkey = start")
def _(spark, sf):
    asked = corpus.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("asked"))
    return X.order_warnings(asked, G.chain_ends(spark, _chain(spark, sf)), "o_orderkey", "asked")


@query("g09b_scheme_expansions", f"{_W}, n AS ({_ENTITIES}), i AS (SELECT DISTINCT source, target FROM edges WHERE relation_type = 'implements') SELECT c_custkey, 'NO ' || {_s('c_custkey % 60')} AS scheme, t.value AS expansion FROM customer JOIN n s ON s.entity_type = 'scheme' AND lower(s.value) = 'no ' || {_s('c_custkey % 60')} JOIN i ON i.source = s.entity_id JOIN n t ON t.entity_id = i.target")
def _(spark, sf):
    asked = corpus.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("NO "), (F.col("c_custkey") % 60).cast("string")).alias("scheme"))
    return X.scheme_expansions(asked, _edges(spark, sf), _schemes(spark, sf), "c_custkey", "scheme")


# Topic tables


def _topics(spark):
    rows = [(t, t.title(), list(w), list(s), list(m), list(d), [p], [o for o in N.TOPICS if o != t][:2]) for t, (w, s, m, d, p) in N.TOPICS.items()]
    a = "array<string>"
    return spark.createDataFrame(rows, f"topic string, name string, keywords {a}, schemes {a}, metrics {a}, districts {a}, patterns {a}, related {a}")


@query("q05b_topic_table", f"{_TOP} SELECT chunk_id, topic, score, CASE WHEN score >= 3 THEN 'high' ELSE 'medium' END AS level, rank FROM r WHERE rank <= 5")
def _(spark, sf):
    return X.best_topics(X.topic_scores(corpus.chunks(spark, sf), "chunk_id", "text", _topics(spark)), "chunk_id")


_TOPIC = "CASE c_custkey % 4 WHEN 0 THEN 'rte_section_12_1_c' WHEN 1 THEN 'rte_compliance' WHEN 2 THEN 'school_management_committees' ELSE 'ptr_norms' END"
_NUMBER = "CASE WHEN c_custkey % 3 = 0 THEN '12' WHEN c_custkey % 3 = 1 THEN '21' ELSE '5' END"
_ACT = "CASE WHEN c_custkey % 5 < 3 THEN 'RTE Act' WHEN c_custkey % 5 = 3 THEN 'Other Act' END"


@query("q04_legal_reference_score", "SELECT c_custkey, (CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 AND c_custkey % 5 < 3 THEN 3.0 WHEN c_custkey % 4 = 1 AND c_custkey % 5 < 3 THEN 2.0 WHEN c_custkey % 4 = 2 AND c_custkey % 3 = 1 THEN 2.5 ELSE 0 END + CASE WHEN c_custkey % 5 < 3 THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM customer")
def _(spark, sf):
    return corpus.table(spark, sf, "customer").select("c_custkey", X.legal_reference_score(F.expr(_TOPIC), F.lit("section"), F.expr(_NUMBER), F.expr(_ACT)).alias("score"))


@query("q06_related_topics", "SELECT * FROM (VALUES " + ", ".join(f"({lit(t)}, {lit(o)})" for t in ("access", "finance") for o in [x for x in N.TOPICS if x != t][:2]) + ") v(topic, related)")
def _(spark, sf):
    return X.related_topics(_topics(spark), spark.createDataFrame([("access",), ("finance",), ("none",)], "topic string"))


@query("a28_topic_lookup", "SELECT * FROM (VALUES ('keyword', 'access'), ('keyword', 'finance'), ('scheme', 'access'), ('metric', 'quality'), ('district', 'finance')) v(asked, topic) WHERE topic NOT IN ('none') AND NOT (asked = 'keyword' AND topic = 'finance')")
def _(spark, sf):
    t = _topics(spark)
    out = X.topics_by_keyword(t, "Enroll").withColumn("asked", F.lit("keyword"))
    for kind, value in (("scheme", "Amma Vodi"), ("metric", "Pass Percentage"), ("district", "KURNOOL")):
        out = out.unionByName(X.topics_by_entity(t, value, kind).withColumn("asked", F.lit(kind)))
    return out.select("asked", "topic")


_CATEGORY = {"act": "legal_doc_ids", "government_order": "go_doc_ids", "judicial": "judicial_doc_ids", "data_report": "data_doc_ids"}
_CAT = "CASE doc_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in _CATEGORY.items()) + " ELSE 'external_doc_ids' END"


@query("a27_update_documents", f"{_TOP} SELECT topic, {_CAT} AS category, c.doc_id FROM r JOIN chunks c USING (chunk_id) WHERE rank <= 5 UNION SELECT 'access', 'legal_doc_ids', c_custkey FROM customer")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    m = N.topic_matches(c, "chunk_id", "text").join(c.select("chunk_id", "doc_id", "doc_type"), "chunk_id")
    old = corpus.table(spark, sf, "customer").select(F.lit("access").alias("topic"), F.lit("legal_doc_ids").alias("category"), F.col("c_custkey").alias("doc_id"))
    return X.update_documents(old, m, _CATEGORY)


@query("c13_type_of_document_id", f"{W}, i AS (SELECT chunk_id, doc_type || '_' || {_s('chunk_id')} AS id FROM chunks) SELECT chunk_id, CASE WHEN id LIKE '%act%' OR id LIKE '%rule%' THEN 'acts' WHEN id LIKE '%go%' OR id LIKE '%order%' THEN 'government_orders' WHEN id LIKE '%case%' OR id LIKE '%court%' OR id LIKE '%judgment%' THEN 'judicial_documents' WHEN id LIKE '%budget%' OR id LIKE '%data%' OR id LIKE '%report%' THEN 'data_reports' ELSE 'external_sources' END AS doc_class FROM i")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    return c.select("chunk_id", C.type_of_document_id(F.concat_ws("_", "doc_type", F.col("chunk_id").cast("string"))).alias("doc_class"))


_ASKED = "CASE c_custkey % 3 WHEN 0 THEN '  the goverment   enrolment in vizag ' WHEN 1 THEN 'PTR under Section 12 in Bezawada' ELSE 'plain words' END"


@query("t20_normalize_query", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'the government enrollment in Visakhapatnam' WHEN 1 THEN 'PTR (Pupil-Teacher Ratio) under Section 12 in Vijayawada' ELSE 'plain words' END AS normalized, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS n_legal_refs, c_custkey % 3 <> 2 AS changed FROM customer")
def _(spark, sf):
    n = N.normalize_query(F.expr(_ASKED))
    return corpus.table(spark, sf, "customer").select("c_custkey", n["normalized"].alias("normalized"), F.size(n["legal_refs"]).alias("n_legal_refs"), n["changed"].alias("changed"))


# The chunkers of each type, over all texts

_SUBS = "text || chr(10) || '(a) first point' || chr(10) || '(b) second point'"
_HEAD = r"(?i)(?:Section|Article)\s+(\d+(?:\([a-z]\))?)"


@query(
    "k08_legal_chunks",
    f"{W}, t AS (SELECT chunk_id, {_SUBS} AS t FROM chunks), m AS (SELECT chunk_id, string_split_regex(t, {lit(H.LEGAL_HEADING)}) AS s, regexp_extract_all(t, {lit(H.LEGAL_HEADING)}) AS h FROM t), "
    f"x AS (SELECT chunk_id, unnest(range(1, len(h) + 1)) AS i, h, s FROM m), y AS (SELECT chunk_id, i, regexp_extract(h[i], {lit(_HEAD)}, 1) AS n, trim(regexp_replace(h[i], {lit(_HEAD)}, '')) AS title, {_TRIM.format('s[i + 1]')} AS body FROM x), "
    f"z AS (SELECT *, 'Section ' || n || ': ' || title || chr(10) || chr(10) AS lead, list_transform(regexp_extract_all(body, {lit(H.SUBSECTION)}), lambda q: {_TRIM.format('q')}) AS subs FROM y) "
    f"SELECT chunk_id, 'legal_preamble' AS chunk_type, '0' AS number, {_TRIM.format('s[1]')} AS text FROM m WHERE {_TRIM.format('s[1]')} <> '' "
    "UNION ALL SELECT chunk_id, 'legal_section', n, lead || body FROM z WHERE length(body) <= 60 OR len(subs) = 0 "
    "UNION ALL SELECT chunk_id, 'legal_subsection', n || '_' || CAST(generate_subscripts(subs, 1) AS STRING), lead || unnest(subs) FROM z WHERE length(body) > 60 AND len(subs) > 0",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", F.expr(_SUBS).alias("t"))
    return H.legal_chunks(c, "chunk_id", "t", 60).drop("chunk_no")


_ORDERED = "'Department' || chr(10) || 'Whereas ' || title || ' is due' || chr(10) || 'It is hereby ordered:' || chr(10) || text || chr(10) || 'Annexure I' || chr(10) || 'row ' || CAST(n1 AS STRING)"


@query(
    "k09_order_chunks",
    f"{W}, t AS (SELECT chunk_id, list_filter(string_split({_ORDERED}, chr(10)), lambda x: trim(x) <> '') AS ls FROM chunks), l AS (SELECT chunk_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t), "
    "s AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'annexure') THEN 3 WHEN regexp_matches(lower(line), 'it is hereby ordered|now therefore|orders?\\b') THEN 2 WHEN regexp_matches(lower(line), 'whereas|in exercise of|having considered') THEN 1 ELSE 0 END AS st FROM l), "
    "m AS (SELECT *, max(st) OVER (PARTITION BY chunk_id ORDER BY i) AS part FROM s), g AS (SELECT chunk_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (part = 0), '') AS header, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (part = 1), '') AS pre, string_agg(line, chr(10) ORDER BY i) FILTER (part = 3) AS ann FROM m GROUP BY 1), "
    "o AS (SELECT chunk_id, line, row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS n FROM m WHERE part = 2) "
    "SELECT chunk_id, 'go_preamble' AS chunk_type, '0' AS number, header || chr(10) || chr(10) || 'Preamble:' || chr(10) || pre AS text FROM g WHERE pre <> '' "
    "UNION ALL SELECT chunk_id, 'go_order', CAST(n AS STRING), 'Context: ' || CASE WHEN pre <> '' THEN substr(pre, 1, 200) || '...' ELSE '' END || chr(10) || chr(10) || 'Order ' || CAST(n AS STRING) || ': ' || line FROM o JOIN g USING (chunk_id) "
    "UNION ALL SELECT chunk_id, 'go_annexure', '1', 'Annexure 1:' || chr(10) || ann FROM g WHERE ann IS NOT NULL",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", F.expr(_ORDERED).alias("t"))
    return H.order_chunks(c, "chunk_id", "t").drop("chunk_no")


@query(
    "k10_judicial_chunks",
    f"{W}, h AS (SELECT chunk_id, text, list_filter(list_transform(regexp_extract_all(text, {lit(H.HOLDING)}), lambda x: trim(x)), lambda x: length(x) > 30) AS hs, array_to_string(list_slice(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> ''), 1, 3), chr(10) || chr(10)) AS facts FROM chunks) "
    "SELECT chunk_id, 'judicial_fact' AS chunk_type, '0' AS number, 'Facts:' || chr(10) || facts AS text FROM h UNION ALL SELECT chunk_id, 'judicial_holding', CAST(generate_subscripts(hs, 1) AS STRING), 'Holding ' || CAST(generate_subscripts(hs, 1) AS STRING) || ':' || chr(10) || unnest(hs) FROM h",
)
def _(spark, sf):
    return H.judicial_chunks(corpus.chunks(spark, sf), "chunk_id", "text", 30).drop("chunk_no")


_TABLE = "text || chr(10) || 'Guntur 12 34' || chr(10) || 'Krishna ' || CAST(v AS STRING) || ' 7' || chr(10) || 'no numbers' || chr(10) || '1 2' || chr(10)"


@query(
    "k11_data_chunks",
    f"{W}, t AS (SELECT chunk_id, {_TABLE} AS t FROM chunks), s AS (SELECT chunk_id, list_transform(regexp_extract_all(t, {lit(H.SUMMARY)}), lambda x: {_TRIM.format('x')}) AS ss FROM t), "
    "l AS (SELECT chunk_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM t), r AS (SELECT *, i - row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS g FROM l WHERE regexp_matches(line, '\\d.*\\s.*\\d')), "
    "q AS (SELECT chunk_id, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS lines FROM r GROUP BY chunk_id, g), n AS (SELECT chunk_id, lines, row_number() OVER (PARTITION BY chunk_id ORDER BY first) AS k FROM q) "
    "SELECT chunk_id, 'data_summary' AS chunk_type, generate_subscripts(ss, 1)::INT AS number, unnest(ss) AS text FROM s UNION ALL SELECT chunk_id, 'data_table', k::INT, 'Table ' || CAST(k AS STRING) || ':' || chr(10) || lines FROM n",
)
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("chunk_id", F.expr(_TABLE).alias("t"))
    return H.data_chunks(c, "chunk_id", "t")
