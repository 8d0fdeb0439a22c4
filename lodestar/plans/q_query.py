"""Queries of sectioning, chunking, query understanding, routing and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as K
from ..operators import understanding as N
from . import corpus
from .duck import count, has, lit

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


W = corpus.WITH


@query(
    "k01_act_sections",
    f"{W}, m AS (SELECT chunk_id, text, regexp_extract_all(text, {lit(K.ACT_HEADING)}) AS h FROM chunks), p AS (SELECT chunk_id, h, regexp_replace(text, {lit('(' + K.ACT_HEADING + ')')}, '<<|>>', 'g') AS t FROM m), s AS (SELECT chunk_id, h, string_split(t, '<<|>>')[2:] AS b FROM p), "
    "r AS (SELECT chunk_id, unnest(h) AS title, unnest(b) AS body, generate_subscripts(h, 1) - 1 AS position FROM s) SELECT chunk_id, position, 'sec_' || regexp_extract(title, '(?i)Section\\s+(\\d+[A-Z]?)', 1) AS section_id, trim(title) AS section_title, regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', '') AS text, length(regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', '')) AS char_count FROM r UNION ALL SELECT chunk_id, 0, 'full_text', 'Full Document', text, length(text) FROM m WHERE len(h) = 0",
)
def _(spark, sf):
    return K.act_sections(corpus.chunks(spark, sf), "chunk_id", "text")


_NUM = "'Preamble' || chr(10) || '1. First point ' || CAST(n1 AS STRING) || chr(10) || 'body one' || chr(10) || '2. Second point' || chr(10) || 'body two'"


@query("k02_numbered_sections", f"{W} SELECT chunk_id, p AS position, 'para_' || CAST(p + 1 AS STRING) AS section_id, CASE p WHEN 0 THEN '1. First point ' || CAST(n1 AS STRING) ELSE '2. Second point' END AS section_title, CASE p WHEN 0 THEN 'body one' ELSE 'body two' END AS text FROM chunks, (SELECT unnest([0, 1]) AS p) q")
def _(spark, sf):
    return K.numbered_sections(corpus.chunks(spark, sf).select("chunk_id", F.expr(_NUM).alias("t")), "chunk_id", "t")


@query("k05_generic_sections", "SELECT conv_id, turn, 0 AS position, trim(text) AS text FROM conversations WHERE length(text) < 5000 AND trim(text) <> '' AND NOT contains(text, chr(10) || chr(10))")
def _(spark, sf):
    # All texts; the SQL has only those that stay in one section, which all of the stored tables do.
    c = corpus.table(spark, sf, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return K.generic_sections(c, "id", "text").select("id.conv_id", "id.turn", "position", "text")


@query("k12_general_chunks", "WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents), f(doc_id, parts, i, now, k) AS (SELECT doc_id, parts, 2, parts[1], 0 FROM p WHERE len(parts) > 0 UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN length(now) + length(parts[i]) > 1000 THEN right(now, 100) || chr(10) || chr(10) || parts[i] ELSE now || chr(10) || chr(10) || parts[i] END, k + CASE WHEN length(now) + length(parts[i]) > 1000 THEN 1 ELSE 0 END FROM f WHERE i <= len(parts)) SELECT doc_id, k AS position, arg_max(now, i) AS text FROM f GROUP BY 1, 2")
def _(spark, sf):
    return K.general_chunks(corpus.table(spark, sf, "documents"), "doc_id", "text", separator="\n")


@query("k21_sentence_chunks", "WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents), f(doc_id, parts, i, now, k) AS (SELECT doc_id, parts, 2, parts[1], 0 FROM p WHERE len(parts) > 0 UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN length(now) + length(parts[i]) > 1000 THEN right(now, 100) || ' ' || parts[i] ELSE now || ' ' || parts[i] END, k + CASE WHEN length(now) + length(parts[i]) > 1000 THEN 1 ELSE 0 END FROM f WHERE i <= len(parts)) SELECT doc_id, k AS position, arg_max(now, i) AS text FROM f GROUP BY 1, 2")
def _(spark, sf):
    return K.sentence_chunks(corpus.table(spark, sf, "documents"), "doc_id", "text")


@query("k12b_chunk_counts", "WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents), f(doc_id, parts, i, len, n) AS (SELECT doc_id, parts, 2, length(parts[1]), 1 FROM p WHERE len(parts) > 0 UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN f.len + length(parts[i]) > 1000 THEN least(100, f.len) + 2 + length(parts[i]) ELSE f.len + 2 + length(parts[i]) END, n + CASE WHEN f.len + length(parts[i]) > 1000 THEN 1 ELSE 0 END FROM f WHERE i <= len(parts)) SELECT doc_id, max(n)::INT AS n_chunks FROM f GROUP BY 1")
def _(spark, sf):
    return K.general_chunks(corpus.table(spark, sf, "documents"), "doc_id", "text", separator="\n").groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks"))


_KIND = "CASE kind WHEN 1 THEN 'legal_section' WHEN 0 THEN 'go_order' WHEN 4 THEN 'judicial_holding' ELSE 'general_paragraph' END"


@query("k19_importance", f"{W} SELECT chunk_id, round(least(1.0, {' + '.join(f'CASE WHEN contains(lower(text), {lit(t)}) THEN 0.1 ELSE 0 END' for t in K.LEGAL_TERMS)} + CASE {_KIND} WHEN 'legal_section' THEN 0.3 WHEN 'go_order' THEN 0.3 WHEN 'judicial_holding' THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) BETWEEN 100 AND 500 THEN 0.2 ELSE 0 END), 6) AS importance FROM chunks")
def _(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", F.round(K.importance(F.col("text"), F.expr(_KIND)), 6).alias("importance"))


@query("k20_merge_small", f"{W}, c AS (SELECT doc_id, pos, chunk_id, CAST(floor(kind / 4) AS INT) AS key, text FROM chunks), n AS (SELECT *, lead(key) OVER (PARTITION BY doc_id ORDER BY pos) = key AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 50 AS joins FROM c), r AS (SELECT *, coalesce(sum(CASE WHEN coalesce(joins, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM n), q AS (SELECT *, floor((row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1) / 2) AS pair FROM r) SELECT doc_id, min(pos) AS pos, count(*)::INT AS n_merged, sum(length(text) + 2)::BIGINT - 2 AS chars FROM q GROUP BY doc_id, run, pair")
def _(spark, sf):
    c = corpus.chunks(spark, sf).select("doc_id", "pos", F.floor(F.col("kind") / 4).cast("int").alias("key"), "text")
    return K.merge_small(c, "doc_id", "pos", "text", "key").select("doc_id", "pos", "n_merged", F.length("text").cast("long").alias("chars"))


@query("k15_order_parts", f"{W}, l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM chunks), s AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'annexure') THEN 3 WHEN regexp_matches(lower(line), 'it is hereby ordered|now therefore|orders?\\b') THEN 2 WHEN regexp_matches(lower(line), 'whereas|in exercise of|having considered') THEN 1 ELSE 0 END AS st FROM l), m AS (SELECT *, max(st) OVER (PARTITION BY chunk_id ORDER BY line_no) AS state FROM s) SELECT chunk_id, line_no, ['header', 'preamble', 'orders', 'annexures'][state + 1] AS part FROM m")
def _(spark, sf):
    return K.order_parts(corpus.chunks(spark, sf), "chunk_id", "text").select("chunk_id", "line_no", "part")


# Queries put to the engine, made from customers so that there are many.
_Q = "CASE c_custkey % 8 WHEN 0 THEN 'What is the PTR in Guntur district for 2023-24?' WHEN 1 THEN 'List all schemes under Section 12 of the act' WHEN 2 THEN 'How to apply for Amma Vodi scheme benefits' WHEN 3 THEN 'Compare enrollment and dropout trend from 2015' WHEN 4 THEN 'Explain the judgment of the high court' WHEN 5 THEN 'Which government order is superseded' WHEN 6 THEN 'teacher policy budget' ELSE 'Suggest ideas for school quality improvement or district budget and teacher training in every mandal of the state' END"
_QW = f"WITH q AS (SELECT c_custkey, {_Q} AS query, lower({_Q}) AS q FROM customer)"


def _queries(spark, sf):
    return corpus.dealt(corpus.table(spark, sf, "customer")).select("c_custkey", F.expr(_Q).alias("query"))


_SC = {k: " + ".join([f"CASE WHEN {has('q', p)} THEN 0.4 ELSE 0 END" for p in v[0]] + [f"CASE WHEN contains(q, {lit(w)}) THEN 0.2 ELSE 0 END" for w in v[1]]) for k, v in N.INTENTS.items()}
_IS = f"{_QW}, s AS (SELECT *, {', '.join(f'round({v}, 6) AS s_{k}' for k, v in _SC.items())} FROM q), b AS (SELECT *, greatest({', '.join(f's_{k}' for k in _SC)}) AS best FROM s), p AS (SELECT *, CASE WHEN best = 0 THEN 'factual_lookup' {' '.join(f'WHEN s_{k} = best THEN {lit(k)}' for k in _SC)} END AS primary_intent FROM b)"
_HINT = "list_sort(list_distinct(" + " || ".join(f"CASE WHEN primary_intent = {lit(k)} OR s_{k} >= 0.3 THEN {list(v[2])!r}::VARCHAR[] ELSE []::VARCHAR[] END" for k, v in N.INTENTS.items()) + "))"
_CX = "CASE WHEN n < 5 AND cl = 1 THEN 'simple' WHEN n < 15 AND cl <= 2 THEN 'moderate' ELSE 'complex' END"


@query("n01_intents", f"{_IS} SELECT c_custkey, primary_intent, CAST(CASE WHEN best = 0 THEN 0.5 ELSE least(best, 1.0) END AS DOUBLE) AS primary_score, {' + '.join(f'CASE WHEN s_{k} >= 0.3 AND primary_intent <> {lit(k)} THEN 1 ELSE 0 END' for k in _SC)} AS n_secondary FROM p")
def _(spark, sf):
    return N.intents(_queries(spark, sf), "query").select("c_custkey", "primary_intent", "primary_score", F.size("secondary_intents").alias("n_secondary"))


@query("n04_verticals", f"{_IS}, h AS (SELECT c_custkey, {_HINT} AS v FROM p) SELECT c_custkey, array_to_string(CASE WHEN len(v) > 0 THEN v ELSE {list(N.DEFAULT_VERTICALS)!r} END, ',') AS verticals FROM h")
def _(spark, sf):
    return N.intents(_queries(spark, sf), "query").select("c_custkey", F.array_join("suggested_verticals", ",").alias("verticals"))


_NWQ = "len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> ''))"


@query("n03_type_and_complexity", f"{_QW}, w AS (SELECT *, {_NWQ} AS n, {count('q', ' and ')} + {count('q', ' or ')} + 1 AS cl FROM q) SELECT c_custkey, CASE WHEN regexp_matches(q, '^(?:what|who|when|where|why|how|which)') THEN 'question' WHEN regexp_matches(q, 'show|list|get|find') THEN 'request' WHEN contains(q, '?') THEN 'question' ELSE 'statement' END AS query_type, {_CX} AS complexity FROM w")
def _(spark, sf):
    return _queries(spark, sf).select("c_custkey", N.query_type(F.col("query")).alias("query_type"), N.query_complexity(F.col("query"), F.lit(0)).alias("complexity"))


_EX = [("original", "1.0", None, None)] + [(kind, w, word, o) for kind, w, t in (("synonym", "0.8", N.SYNONYMS), ("legal", "0.75", N.LEGAL_TERMS)) for word, os in t.items() for o in os]
_EXSQL = " UNION ALL ".join(f"SELECT c_custkey, {'q' if word is None else f'regexp_replace(q, {lit(rf"\b{word}\b")}, {lit(o)}, {lit("g")})'} AS text, {lit(kind)} AS kind, CAST({w} AS DOUBLE) AS weight, {i} AS seq FROM q" + ("" if word is None else f" WHERE {has('q', rf'\b{word}\b')}") for i, (kind, w, word, o) in enumerate(_EX))


@query("n05_expansions", f"{_QW}, e AS ({_EXSQL}), d AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, text ORDER BY seq) AS f FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY weight DESC, seq) AS rank FROM d WHERE f = 1) SELECT c_custkey, text, kind, weight, rank FROM r WHERE rank <= 5")
def _(spark, sf):
    return N.expansions(_queries(spark, sf), "c_custkey", "query")


def _agent(i: int, agent: str) -> str:
    words, boost, vertical = N.AGENTS[agent]
    key = f"({' + '.join(f'CASE WHEN contains(q, {lit(w)}) THEN 1 ELSE 0 END' for w in words)}) / {len(words)} * 0.4" if words else "0"
    intent = "CASE primary_intent " + " ".join(f"WHEN {lit(k)} THEN {v.get(agent, 0)}" for k, v in N.INTENT_AGENTS.items()) + " ELSE 0 END"
    return f"SELECT c_custkey, complexity, {lit(agent)} AS agent, {i} AS seq, CAST(round(least(1.0, ({key} + CASE WHEN list_contains(v, {lit(vertical)}) THEN 0.3 ELSE 0 END + {intent} + {boost}) * 0.8), 6) AS DOUBLE) AS confidence FROM h"


@query(
    "r24_agent_routing",
    f"{_IS}, w AS (SELECT *, {_NWQ} AS n, {count('q', ' and ')} + {count('q', ' or ')} + 1 AS cl, {_HINT} AS v0 FROM p), h AS (SELECT c_custkey, q, primary_intent, CASE WHEN len(v0) > 0 THEN v0 ELSE {list(N.DEFAULT_VERTICALS)!r} END AS v, {_CX} AS complexity FROM w), "
    f"a AS ({' UNION ALL '.join(_agent(i, a) for i, a in enumerate(N.AGENTS))}), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY confidence DESC, seq) AS rank FROM a WHERE confidence > 0.1) SELECT c_custkey, agent, confidence, rank FROM r WHERE rank <= CASE complexity WHEN 'simple' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END",
)
def _(spark, sf):
    q = N.intents(_queries(spark, sf), "query").withColumn("complexity", N.query_complexity(F.col("query"), F.lit(0)))
    return N.route(q, "c_custkey", "query", "primary_intent", "complexity", "suggested_verticals")


def _topic(t: str) -> str:
    words, schemes, metrics, districts, pattern = N.TOPICS[t]
    key = " + ".join(f"CASE WHEN contains(low, {lit(w)}) THEN 2.0 ELSE ({' + '.join(f'CASE WHEN contains(low, {lit(p)}) THEN 1 ELSE 0 END' for p in w.split())}) / {len(w.split())} END" for w in words)
    ent = " + ".join([f"CASE WHEN contains(low, {lit(x)}) THEN {v} ELSE 0 END" for names, v in ((schemes, 3), (metrics, 2), (districts, 1.5)) for x in names] or ["0"])
    return f"SELECT chunk_id, {lit(t)} AS topic, CAST(round(({key}) + ({ent}) * 1.2 + {count('text', pattern)} * 1.5 * 1.3, 6) AS DOUBLE) AS score FROM (SELECT *, lower(text) AS low FROM chunks) l"


_TOP = f"{W}, t AS ({' UNION ALL '.join(map(_topic, N.TOPICS))}), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, topic) AS rank FROM t WHERE score >= 1.5)"


@query("q05_topic_matching", f"{_TOP} SELECT chunk_id, topic, score, CASE WHEN score >= 3 THEN 'high' ELSE 'medium' END AS level, rank FROM r WHERE rank <= 5")
def _(spark, sf):
    return N.topic_matches(corpus.chunks(spark, sf), "chunk_id", "text")


@query("a23_topic_statistics", f"{_TOP} SELECT topic, count(*) AS n, count(*) FILTER (score >= 3) AS n_high, round(100.0 * count(*) / (SELECT count(*) FROM chunks), 4) AS coverage FROM r WHERE rank <= 5 GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    total = c.agg(F.count("*").alias("total"))
    t = N.topic_matches(c, "chunk_id", "text").groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "high").alias("n_high"))
    return t.crossJoin(F.broadcast(total)).select("topic", "n", "n_high", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("coverage"))  # total: one row


@query("n08_carry_forward", "WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || CAST(turn AS VARCHAR) END AS v FROM conversations), c AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM t) SELECT conv_id, turn, coalesce(v, b) AS carried, CAST(CASE WHEN v IS NOT NULL THEN 1.0 WHEN b IS NOT NULL THEN 0.7 END AS DOUBLE) AS carry_confidence FROM c")
def _(spark, sf):
    t = corpus.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("v"))
    return N.carry_forward(t, "conv_id", "turn", "v").drop("v")


@query("n11_answer_mode", f"{_QW} SELECT c_custkey, CASE WHEN {has('q', r'\b(?:idea|brainstorm|suggest)')} THEN 'brainstorming' WHEN {has('q', r'\b(?:analy|deep|compare|explain)')} THEN 'pro_deepthink' ELSE 'normal_qa' END AS mode FROM q")
def _(spark, sf):
    return _queries(spark, sf).select("c_custkey", N.mode(F.col("query")).alias("mode"))


_CARRY = "t AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN role || CAST(turn AS VARCHAR) END AS v FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM t)"


# RE2 has no lookaround, so its rule takes the neighbours of the word along; they are letters, numbers or _ of any script.
@query("n08b_resolve_references", f"WITH {_CARRY} SELECT conv_id, turn, CASE WHEN coalesce(v, b) IS NULL THEN text ELSE regexp_replace(text, '(?is)^(|.*?[^\\p{{L}}\\p{{N}}_])(?:it|its|that|this)($|[^\\p{{L}}\\p{{N}}_])', '\\1' || coalesce(v, b) || '\\2') END AS resolved FROM c")
def _(spark, sf):
    t = corpus.table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", "text", F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("v"))
    c = N.carry_forward(t, "conv_id", "turn", "v")
    return c.select("conv_id", "turn", N.resolve_reference(F.col("text"), F.col("carried")).alias("resolved"))


@query("n08c_topic_thread", "SELECT conv_id, turn, count(DISTINCT role) OVER w AS n_topics FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return N.topic_thread(corpus.table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", F.size("thread").cast("long").alias("n_topics"))
