"""Queries of the graph and join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.scratch import shared_folder
from . import corpus
from .duck import lit

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# A graph of order numbers from orders and customers: 90 nodes at any scale of edges.
_EDGES = "SELECT CAST(n1 AS BIGINT) AS source, CAST(n2 AS BIGINT) AS target, CASE kind WHEN 0 THEN 'supersedes' WHEN 1 THEN 'amends' WHEN 2 THEN 'implements' WHEN 3 THEN 'references' ELSE 'mentions' END AS relation_type, CAST(0.5 + (chunk_id % 10) / 20.0 AS DOUBLE) AS confidence, chunk_id FROM chunks"
# Sparse chains: each order supersedes an earlier one.
_CHAIN = "SELECT CAST(o_orderkey AS BIGINT) AS source, CAST(floor(o_orderkey / 3) AS BIGINT) AS target, CAST(0.9 + (o_orderkey % 2) / 20.0 AS DOUBLE) AS confidence FROM orders"
_NODES = "SELECT CAST(n1 AS BIGINT) AS entity_id, CASE WHEN n1 % 2 = 0 THEN 'government_order' ELSE 'legal_section' END AS entity_type, 'No ' || CAST(n1 AS STRING) AS value FROM chunks GROUP BY n1"


def _edges(spark, sf):
    return spark.sql(_EDGES.replace("FROM chunks", "FROM {chunks}"), chunks=corpus.chunks(spark, sf))


def _nodes(spark, sf):
    return spark.sql(_NODES.replace("FROM chunks", "FROM {chunks}"), chunks=corpus.chunks(spark, sf))


def _chain(spark, sf):
    return spark.sql(_CHAIN.replace("FROM orders", "FROM {orders}"), orders=corpus.table(spark, sf, "orders"))


_W = f"{corpus.WITH}, edges AS ({_EDGES}), nodes AS ({_NODES})"


@query("j01_relationship_query", f"{_W} SELECT e.chunk_id, e.source, e.target, e.relation_type, s.value AS source_value, t.value AS target_value, e.confidence FROM edges e JOIN nodes s ON e.source = s.entity_id JOIN nodes t ON e.target = t.entity_id WHERE e.source <> e.target AND e.relation_type = 'supersedes'")
def _(spark, sf):
    return G.with_endpoints(_edges(spark, sf), _nodes(spark, sf)).where("relation_type = 'supersedes'").select("chunk_id", "source", "target", "relation_type", "source_value", "target_value", "confidence")


@query("j02_referential_check", f"{_W} SELECT relation_type, count(*) AS n FROM edges WHERE source IN (SELECT entity_id FROM nodes) AND target IN (SELECT entity_id FROM nodes) AND source <> target GROUP BY 1")
def _(spark, sf):
    return G.with_endpoints(_edges(spark, sf), _nodes(spark, sf)).groupBy("relation_type").agg(F.count("*").alias("n"))


@query("j03_insert_if_absent", f"{_W}, f AS (SELECT source, target, relation_type, min(chunk_id) AS chunk_id FROM edges GROUP BY 1, 2, 3) SELECT source, target, relation_type FROM f WHERE relation_type = 'mentions' UNION ALL SELECT DISTINCT source, target, 'mentions' AS relation_type FROM edges WHERE relation_type = 'amends' AND NOT EXISTS (SELECT 1 FROM edges m WHERE m.relation_type = 'mentions' AND m.source = edges.source AND m.target = edges.target)")
def _(spark, sf):
    e = _edges(spark, sf)
    old = e.where("relation_type = 'mentions'").select("source", "target", "relation_type").distinct()
    new = e.where("relation_type = 'amends'").select("source", "target", F.lit("mentions").alias("relation_type"), "chunk_id")
    return G.insert_absent(old, new, ["source", "target"], "chunk_id")


@query("j04_entity_lookup", f"{_W} SELECT n_nationkey, entity_id FROM nation JOIN nodes ON entity_type = 'government_order' AND lower(value) = 'no ' || CAST(n_nationkey * 2 + 2 AS STRING)")
def _(spark, sf):
    w = corpus.table(spark, sf, "nation").select("n_nationkey", F.lit("government_order").alias("entity_type"), F.concat(F.lit("NO "), (F.col("n_nationkey") * 2 + 2).cast("string")).alias("value"))
    return G.lookup(_nodes(spark, sf), w).select("n_nationkey", "entity_id")


@query("j05_related_entities", f"{_W} SELECT DISTINCT e.source, n.entity_id, n.value FROM edges e JOIN nodes n ON e.target = n.entity_id WHERE e.relation_type = 'implements'")
def _(spark, sf):
    return _edges(spark, sf).where("relation_type = 'implements'").join(_nodes(spark, sf), F.col("target") == F.col("entity_id")).select("source", "entity_id", "value").distinct()


@query("j06_chunks_by_document", f"{corpus.WITH} SELECT d.doc_id, count(*) AS n, sum(length(c.text)) AS chars FROM (SELECT DISTINCT doc_id FROM chunks WHERE kind = 0) d JOIN chunks c USING (doc_id) GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    return c.join(c.where("kind = 0").select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("j13_document_text", f"{corpus.WITH} SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM chunks GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return c.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


@query("j10_reference_reverse_index", f"{corpus.WITH}, r AS (SELECT chunk_id, doc_id, unnest(list_distinct(regexp_extract_all(text, {lit('(?i)Section\\s+(\\d+)')}, 1))) AS ref FROM chunks), o AS (SELECT doc_id, chunk_id, regexp_extract(text, {lit('(?i)G\\.O\\.Ms\\.No\\.\\s*(\\d+)')}, 1) AS own FROM chunks) SELECT ref, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_chunk FROM r GROUP BY 1")
def _(spark, sf):
    r = corpus.chunks(spark, sf).select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)Section\s+(\d+)"), F.lit(1)))).alias("ref"))
    return r.groupBy("ref").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query("g02_inverse_edges", f"{_W} SELECT target AS source, source AS target, CASE relation_type WHEN 'supersedes' THEN 'superseded_by' WHEN 'amends' THEN 'amended_by' WHEN 'implements' THEN 'implemented_by' ELSE 'referenced_by' END AS relation_type, round(confidence * 0.9, 6) AS confidence FROM edges WHERE relation_type <> 'mentions'")
def _(spark, sf):
    return G.inverse_edges(_edges(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(
    "g03_transitive_closure",
    f"WITH RECURSIVE e AS ({_CHAIN}), walk(source, target, depth, confidence) AS (SELECT source, target, 1, confidence * 0.8 FROM e WHERE source <> target UNION ALL SELECT w.source, e.target, w.depth + 1, w.confidence * e.confidence * 0.8 FROM walk w JOIN e ON w.target = e.source WHERE w.depth < 10 AND e.target <> w.source AND w.confidence * e.confidence * 0.8 > 0.3), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY depth, confidence DESC) AS rn FROM walk WHERE confidence > 0.3) SELECT source, target, depth, round(confidence, 6) AS confidence FROM r WHERE rn = 1",
)
def _(spark, sf):
    return G.closure(spark, _chain(spark, sf)).withColumn("confidence", F.round("confidence", 6))


_CW = f"WITH RECURSIVE f AS (SELECT source, min(target) AS target FROM ({_CHAIN}) c GROUP BY 1), chain(start, node, depth) AS (SELECT source, target, 1 FROM f WHERE source <> target UNION ALL SELECT c.start, f.target, c.depth + 1 FROM chain c JOIN f ON c.node = f.source WHERE f.target <> c.node AND f.target <> c.start)"


@query("g06_supersession_chains", f"{_CW} SELECT start, node, depth FROM chain")
def _(spark, sf):
    return G.chains(spark, _chain(spark, sf))


@query("g07_current_order", f"{_CW} SELECT start, arg_max(node, depth) AS current, max(depth)::BIGINT AS length FROM chain GROUP BY 1")
def _(spark, sf):
    return G.chain_ends(spark, _chain(spark, sf))


@query(
    "g10_chain_both_ways",
    f"{_CW}, bf AS (SELECT target AS source, min(source) AS target FROM ({_CHAIN}) c WHERE source <> target GROUP BY 1), bc(start, node, depth) AS (SELECT source, target, 1 FROM bf UNION ALL SELECT b.start, bf.target, b.depth + 1 FROM bc b JOIN bf ON b.node = bf.source), "
    "o AS (SELECT start AS node, arg_max(node, depth) AS oldest, max(depth) AS n_older FROM chain GROUP BY 1), w AS (SELECT start AS node, arg_max(node, depth) AS newest, max(depth) AS n_newer FROM bc GROUP BY 1) "
    "SELECT node, coalesce(oldest, node) AS oldest, coalesce(n_older, 0)::BIGINT AS n_older, coalesce(newest, node) AS newest, coalesce(n_newer, 0)::BIGINT AS n_newer FROM o FULL JOIN w USING (node)",
)
def _(spark, sf):
    return G.chain_sides(spark, _chain(spark, sf))


@query(
    "g01b_closure_in_two_batches",
    f"WITH RECURSIVE e AS (SELECT source, target, max(confidence) AS confidence FROM ({_CHAIN}) c WHERE source <> target GROUP BY 1, 2), walk(source, target, depth, confidence) AS (SELECT source, target, 1, confidence * 0.8 FROM e WHERE source <> target UNION ALL SELECT w.source, e.target, w.depth + 1, w.confidence * e.confidence * 0.8 FROM walk w JOIN e ON w.target = e.source WHERE w.depth < 10 AND e.target <> w.source AND w.confidence * e.confidence * 0.8 > 0.3) "
    "SELECT source, target, depth, round(max(confidence), 6) AS confidence FROM walk WHERE confidence > 0.3 GROUP BY 1, 2, 3",
)
def _(spark, sf):
    """The walks of half of the edges, then those of all of them from these: the same as of all at once."""
    e = G.kept(_chain(spark, sf), shared_folder(spark, "edges"), "0")
    late = F.col("source") % 2 == 1
    old = e.where(~late)
    return G.extend_walks(spark, G.walks(spark, old), old, e.where(late)).withColumn("confidence", F.round("confidence", 6))


@query("g05_expand_with_relationships", f"{_W}, r AS (SELECT source, target, confidence, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS rank FROM (SELECT source, target, max(confidence) AS confidence FROM edges GROUP BY 1, 2) x WHERE confidence > 0.7) SELECT source, target, round(confidence, 6) AS confidence, rank FROM r WHERE rank <= 5")
def _(spark, sf):
    e = _edges(spark, sf).groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    return G.top_related(e).withColumn("confidence", F.round("confidence", 6))


_SUP = " UNION ALL ".join(f"SELECT chunk_id, regexp_extract(text, {lit(G.OWN_NUMBER)}, 1) AS own, CAST(unnest(regexp_extract_all(text, {lit(p)}, 1)) AS INT) AS target, {lit(k)} AS kind, CAST({c} AS DOUBLE) AS confidence FROM chunks" for k, c, p in G.SUPERSESSION)


@query("g11_supersession_extraction", f"{corpus.WITH}, s AS ({_SUP}) SELECT chunk_id, CAST(own AS INT) AS source, target, kind, confidence FROM s WHERE own <> ''")
def _(spark, sf):
    return G.supersessions(corpus.chunks(spark, sf))


@query("g12_current_by_topic", f"{corpus.WITH}, s AS ({_SUP}), e AS (SELECT CAST(own AS INT) AS source, target FROM s WHERE own <> '') SELECT source % 5 AS topic, max(source) AS current, count(DISTINCT source) AS n FROM e WHERE source NOT IN (SELECT target FROM e) GROUP BY 1")
def _(spark, sf):
    e = G.supersessions(corpus.chunks(spark, sf)).select("source", "target")
    gone = e.select(F.col("target").alias("source")).distinct()
    return e.join(gone, "source", "left_anti").groupBy((F.col("source") % 5).alias("topic")).agg(F.max("source").alias("current"), F.countDistinct("source").alias("n"))


@query("g14_chain_validation", f"{_W}, d AS (SELECT DISTINCT source, target FROM edges WHERE relation_type = 'supersedes' AND source <> target) SELECT (SELECT count(*) FROM d a JOIN d b ON a.source = b.target AND a.target = b.source AND a.source < a.target) AS n_cycles, (SELECT count(*) FROM edges WHERE relation_type = 'supersedes' AND confidence < 0.8) AS n_low_confidence")
def _(spark, sf):
    e = _edges(spark, sf).where("relation_type = 'supersedes'")
    d = e.where("source <> target").select("source", "target").distinct()
    back = d.select(F.col("target").alias("source"), F.col("source").alias("target"))
    cycles = d.join(back, ["source", "target"], "left_semi").where("source < target").agg(F.count("*").alias("n_cycles"))
    low = e.agg(F.count_if(F.col("confidence") < 0.8).alias("n_low_confidence"))
    return cycles.crossJoin(low)  # one row each


@query("g16_distinct_supersessions", f"{corpus.WITH}, s AS ({_SUP}) SELECT DISTINCT CAST(own AS INT) AS source, target FROM s WHERE own <> '' AND kind = 'full'")
def _(spark, sf):
    return G.supersessions(corpus.chunks(spark, sf)).where("kind = 'full'").select("source", "target").distinct()


@query("a30_supersession_statistics", f"{corpus.WITH}, s AS ({_SUP}) SELECT kind, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT target) AS n_targets FROM s WHERE own <> '' GROUP BY 1")
def _(spark, sf):
    return G.supersessions(corpus.chunks(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.countDistinct("target").alias("n_targets"))


@query("e18_current_section", f"{corpus.WITH}, s AS (SELECT doc_id, pos, chunk_id, nullif(regexp_extract(text, {lit('(?i)Section\\s+(\\d+)')}, 1), '') AS sec FROM chunks) SELECT chunk_id, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM s")
def _(spark, sf):
    sec = F.regexp_extract("text", r"(?i)Section\s+(\d+)", 1)
    c = corpus.chunks(spark, sf).select("chunk_id", "doc_id", "pos", F.when(sec != "", sec).alias("sec"))
    return G.as_of_last(c, "doc_id", "pos", "sec", "section").select("chunk_id", "section")
