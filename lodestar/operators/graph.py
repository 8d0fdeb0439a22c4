"""Relationship graph: edges, inverse edges, bounded closure, chains. Vertices and edges are DataFrames.

Edges have source, target (any type), relation_type, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

INVERSE = {"supersedes": "superseded_by", "amends": "amended_by", "implements": "implemented_by", "references": "referenced_by"}
INVERSE_DECAY, CLOSURE_DECAY, CLOSURE_FLOOR = 0.9, 0.8, 0.3
#: A key of more rows than this, and of more than one in ``HOT_SHARE`` of all, is joined apart from the others, in ``SALTS`` parts where it is not broadcast.
HOT_ROWS, HOT_SHARE, SALTS = 100_000, 1024, 64


def with_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose both ends exist and differ, with the type and value of each end."""
    e = entities.select("entity_id", "entity_type", "value")
    s = e.select(F.col("entity_id").alias("source"), F.col("entity_type").alias("source_type"), F.col("value").alias("source_value"))
    t = e.select(F.col("entity_id").alias("target"), F.col("entity_type").alias("target_type"), F.col("value").alias("target_value"))
    return edges.where("source <> target").join(s, "source").join(t, "target")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``existing`` and those of ``new`` whose key is in neither it nor an earlier new row."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti").select(existing.columns))


def lookup(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities by (entity_type, value) without case; of equal ones the last id."""
    last = entities.groupBy("entity_type", F.lower("value").alias("_v")).agg(F.max("entity_id").alias("entity_id"))
    w = wanted.withColumn("_v", F.lower("value"))
    return w.join(last, ["entity_type", "_v"]).drop("_v")


def build(chunks: DataFrame, id_col: str, text_col: str) -> dict[str, DataFrame]:
    """The graph of a collection: ``entities`` (each once, by type and value), ``edges`` found in the texts with their inverse ones."""
    from ..functions import extract as E
    from . import evidence as V

    e = E.graph_entities(chunks, id_col, text_col)
    entities = e.groupBy("entity_type", F.lower("value").alias("value")).agg(F.max("confidence").alias("confidence"), F.min(id_col).alias("first_chunk"))
    own = V.relationships(chunks, id_col, text_col).select("source", "target", "relation_type", "confidence")
    return {"entities": entities.withColumn("entity_id", F.concat_ws("_", "entity_type", "value")), "edges": own.unionByName(inverse_edges(own))}


def relations_of_document(rows: DataFrame, documents: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """Rows whose id is ``doc_<document>_...``, joined to the documents by that number, not by a common beginning."""
    own = F.regexp_extract(id_col, r"^doc_(\d+)_", 1).try_cast("long")
    return rows.withColumn(doc_col, own).join(documents.select(doc_col).distinct(), doc_col)


def neighbours(pairs: DataFrame) -> DataFrame:
    """(node, other): every pair (a, b) in both directions."""
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))


def order_id(number: Column, year: Column) -> Column:
    """``GO_number_year``, ``GO_number`` without a year; null without a number."""
    return F.when(number.isNotNull(), F.concat_ws("_", F.lit("GO"), number.cast("string"), year.cast("string")))


def inverse_edges(edges: DataFrame) -> DataFrame:
    """The inverse of every edge of the four invertible types, with a tenth less confidence."""
    m = F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])
    return edges.where(F.col("relation_type").isin(*INVERSE)).select(
        F.col("target").alias("source"), F.col("source").alias("target"), F.element_at(m, F.col("relation_type")).alias("relation_type"), (F.col("confidence") * INVERSE_DECAY).alias("confidence")
    )


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written once to the shared folder (spark.checkpoint.dir) and read back, so a round does not repeat those before it."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def hot_keys(rows: DataFrame, key: str, n: int, keep) -> DataFrame | None:
    """(key): the keys that many of the ``n`` rows have, fewer than ``HOT_SHARE``; None if there are none. ``keep`` stores a table."""
    if n <= HOT_ROWS:
        return None
    hot = keep(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT_ROWS, n // HOT_SHARE)).select(key))
    return None if hot.isEmpty() else hot


def met(rows: DataFrame, on: DataFrame, key: str, n: int, keep) -> DataFrame:
    """The ``n`` rows left joined with ``on``, which has one row a key; the rows of one key need not fit a task, as pointers to the end of chains would."""
    if (hot := hot_keys(rows, key, n, keep)) is None:
        return rows.join(on, key, "left")
    hot = F.broadcast(hot)
    few = F.broadcast(keep(on.join(hot, key, "left_semi")))
    return rows.join(hot, key, "left_anti").join(on, key, "left").unionByName(rows.join(hot, key, "left_semi").join(few, key, "left"))


def met_by_many(rows: DataFrame, on: DataFrame, key: str, n: int, keep) -> DataFrame:
    """The ``n`` rows joined with ``on``, which has several rows a key: the rows of a hot key are dealt out, those of ``on`` repeated for each part."""
    if (hot := hot_keys(rows, key, n, keep)) is None:
        return rows.join(on, key)
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    spread = on.join(hot, key, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(hot, key, "left_anti").join(on, key).unionByName(dealt.join(spread, [key, "_salt"]).drop("_salt"))


def _rounds(spark: SparkSession, first: DataFrame, following, max_depth: int) -> DataFrame:
    """All rows of ``first`` (depth 1) and of what ``following`` makes of each round, until one is empty or the depth is reached.

    Unlike recursive SQL, which Spark stops at a million rows, this holds any number.
    """
    folder = shared_folder(spark, "rounds")
    rows = [kept(first, folder, "1")]
    for depth in range(2, max_depth + 1):
        if rows[-1].isEmpty():
            break
        rows.append(kept(following(rows[-1], depth), folder, str(depth)))
    return reduce(DataFrame.unionByName, rows)


def walks(spark: SparkSession, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(source, target, depth, confidence): of the walks of each length between two nodes the most confident, above the floor.

    Confidence is the product over the walk of edge confidence and decay. Loops are no edges. Walks at or below the floor are left out, as
    their continuations only fall; a pair has a row for each depth, so a round never holds more than one.
    """
    best = F.max("confidence").alias("confidence")
    e = edges.where("source <> target").groupBy("source", "target").agg(best)
    first = e.select("source", "target", F.lit(1).alias("depth"), (F.col("confidence") * CLOSURE_DECAY).alias("confidence")).where(F.col("confidence") > CLOSURE_FLOOR)
    # A walk's confidence falls at least by the decay each hop, so a bounded number of hops is enough.
    return _rounds(spark, first, lambda walk, depth: _longer(walk, e).groupBy("source", "target", "depth").agg(best), max_depth)


def _longer(walk: DataFrame, edges: DataFrame) -> DataFrame:
    """Walks with an edge more, but for those that come back to where they began."""
    hop = edges.select(F.col("source").alias("target"), F.col("target").alias("_next"), F.col("confidence").alias("_confidence"))
    w = walk.join(hop, "target").where("_next <> source").select("source", F.col("_next").alias("target"), (F.col("depth") + 1).alias("depth"), (F.col("confidence") * F.col("_confidence") * CLOSURE_DECAY).alias("confidence"))
    return w.where(F.col("confidence") > CLOSURE_FLOOR)


def shortest(walked: DataFrame) -> DataFrame:
    """(source, target, depth, confidence): of each pair the shortest walk."""
    return walked.groupBy("source", "target").agg(F.min_by(F.struct("depth", "confidence"), "depth").alias("b")).select("source", "target", "b.depth", "b.confidence")


def closure(spark: SparkSession, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """What each node reaches over the edges, by the shortest walk, of equally short ones the most confident."""
    return shortest(walks(spark, edges, max_depth))


def extend_walks(spark: SparkSession, stored: DataFrame, edges: DataFrame, new: DataFrame, max_depth: int = 10) -> DataFrame:
    """The walks of ``edges`` and ``new`` together, from the stored ones of ``edges``: only walks over a new edge are made.

    Such a walk is a stored one (or none), a new edge, and what follows; each round adds an edge of either kind to
    what the round before found. An edge that was known and is not surer now makes no walk.
    """
    best = F.max("confidence").alias("confidence")
    old = edges.where("source <> target").groupBy("source", "target").agg(best)
    added = new.groupBy("source", "target").agg(F.max("confidence").alias("_new"))
    folder = shared_folder(spark, "extended")
    delta = added.join(old, ["source", "target"], "left").where(F.col("confidence").isNull() | (F.col("_new") > F.col("confidence")))
    delta = kept(delta.where("source <> target").select("source", "target", F.col("_new").alias("confidence")), folder, "delta")
    every = kept(old.unionByName(delta).groupBy("source", "target").agg(best), folder, "edges")
    start = delta.select("source", "target", F.lit(1).alias("depth"), (F.col("confidence") * CLOSURE_DECAY).alias("confidence")).where(F.col("confidence") > CLOSURE_FLOOR)
    first = start.unionByName(_longer(stored.where(F.col("depth") < max_depth), delta)).groupBy("source", "target", "depth").agg(best)
    rows = [kept(first, folder, "1")]
    for i in range(2, max_depth + 1):
        if rows[-1].isEmpty():
            break
        rows.append(kept(_longer(rows[-1].where(F.col("depth") < max_depth), every).groupBy("source", "target", "depth").agg(best), folder, str(i)))
    return reduce(DataFrame.unionByName, rows, stored.select("source", "target", "depth", "confidence")).groupBy("source", "target", "depth").agg(best)


def first_edges(edges: DataFrame) -> DataFrame:
    """(node, next): of each node its first edge (the least target); loops are no edges."""
    return edges.where(F.col("source") != F.col("target")).groupBy(F.col("source").alias("node")).agg(F.min("target").alias("next"))


def walk_ends(spark: SparkSession, first: DataFrame) -> DataFrame:
    """(start, current, length): where the walk along (node, next) from each node ends, by pointer doubling.

    Every round joins the pointers with themselves, which doubles their reach, so the rounds are the logarithm of the
    longest walk. A walk ends before it would come to a node for a second time. While a walk that ends is under way,
    every round finishes one of the length just beyond its reach; when none finishes, all that are left lead to a cycle,
    and these are settled by their cycle: they go once around it.
    """
    folder = shared_folder(spark, "ends")
    n = iter(range(10_000))
    keep = lambda df: kept(df, folder, str(next(n)))
    first = keep(first.select("node", "next"))

    def doubled(live: DataFrame, every: DataFrame, left: int) -> DataFrame:
        on = every.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        j = met(live, on, "to", left, keep)
        return j.select("node", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_done", F.lit(True)).alias("done"))

    # Only walks under way move; those that ended are looked up by them.
    live = keep(first.select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")))
    over, left, reach = live.where("done"), live.count(), 1
    while left:
        at, reach = keep(doubled(live, live.unionByName(over), left)), 2 * reach
        over, live = over.unionByName(at.where("done")), at.where(~F.col("done"))
        now = live.count()
        if now == left:
            break
        left = now
    ended = over.select(F.col("node").alias("start"), F.col("to").alias("current"), F.col("steps").alias("length"))
    if not left:
        return ended
    # Each of the rest reaches a cycle in fewer steps than there are of them; then the pointers' ends are the nodes of the cycles.
    while reach < left:
        live, reach = keep(doubled(live, live, left)), 2 * reach
    rest = live
    on_cycle = keep(rest.select(F.col("to").alias("node")).distinct())
    cycle = keep(first.join(on_cycle, "node", "left_semi").select("node", F.col("next").alias("to"), F.col("node").alias("least")))
    size, reach = cycle.count(), 1
    while reach < size:  # the least node of a cycle names it
        on = cycle.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        cycle, reach = keep(cycle.join(on, "to").select("node", F.col("_to").alias("to"), F.least("least", "_least").alias("least"))), 2 * reach
    around = cycle.groupBy("least").agg(F.count("*").alias("size"))
    before = first.join(on_cycle, "node", "left_semi").select(F.col("next").alias("node"), F.col("node").alias("last"))
    once = keep(cycle.select("node", "least").join(around, "least").join(before, "node").select("node", "last", "size"))
    # To the first node of the cycle, by doubling again with the cycles' nodes as ends.
    tail = first.join(rest.select("node"), "node", "left_semi").join(on_cycle, "node", "left_anti")
    enter = walk_ends(spark, tail).select("start", F.col("current").alias("node"), "length") if not tail.isEmpty() else None
    own = once.select(F.col("node").alias("start"), F.col("last").alias("current"), (F.col("size") - 1).alias("length"))
    out = ended.unionByName(own)
    if enter is not None:
        out = out.unionByName(met(enter, once, "node", left, keep).select("start", F.col("last").alias("current"), (F.col("length") + F.col("size") - 1).alias("length")))
    return out


def chain_ends(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(start, current, length): the last node of the chain of first edges from each node: what is current from there."""
    return walk_ends(spark, first_edges(edges))


def chain_sides(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, oldest, n_older, newest, n_newer): both ends of the chain through each node, along the edges and against them."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    older = chain_ends(spark, edges).select(F.col("start").alias("node"), F.col("current").alias("oldest"), F.col("length").alias("n_older"))
    newer = chain_ends(spark, back).select(F.col("start").alias("node"), F.col("current").alias("newest"), F.col("length").alias("n_newer"))
    j = older.join(newer, "node", "full_outer")
    zero = F.lit(0).cast("long")
    return j.select("node", F.coalesce("oldest", "node").alias("oldest"), F.coalesce("n_older", zero).alias("n_older"), F.coalesce("newest", "node").alias("newest"), F.coalesce("n_newer", zero).alias("n_newer"))


def chains(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(start, node, depth): every node of the chain of first edges from each node, until its end or a cycle.

    Known parts of chains are joined at the ends of the pointers, so both double each round; no path is carried along.
    """
    folder = shared_folder(spark, "chains")
    first = kept(first_edges(edges), folder, "first")
    ends = kept(walk_ends(spark, first).select("start", "length"), folder, "ends")
    longest = ends.agg(F.max("length")).first()[0] or 0
    known = first.select(F.col("node").alias("start"), F.col("next").alias("node"), F.lit(1).cast("long").alias("depth"))
    jump, reach = first.select("node", F.col("next").alias("to")), 1
    n = iter(range(10_000))
    keep = lambda df: kept(df, folder, f"hot{next(n)}")
    while reach < longest:
        size = jump.count()
        further = met_by_many(jump.select(F.col("node").alias("_start"), F.col("to").alias("start")), known, "start", size, keep).select(F.col("_start").alias("start"), "node", (F.col("depth") + reach).alias("depth"))
        known = kept(known.unionByName(further), folder, f"known{reach}")
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        jump, reach = kept(met(jump, on, "to", size, keep).where("_to IS NOT NULL").select("node", F.col("_to").alias("to")), folder, f"jump{reach}"), 2 * reach
    return known.join(ends, "start").where(F.col("depth") <= F.col("length")).select("start", "node", F.col("depth").cast("int").alias("depth"))


def top_related(edges: DataFrame, k: int = 5, floor: float = 0.7) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "target"))
    return edges.where(F.col("confidence") > floor).withColumn("rank", rank).where(F.col("rank") <= k)


# Order supersession, (kind, confidence, pattern), full before partial before generic.
_NO = r"G\.?O\.?\s*M\.?S\.?\s*No\.?\s*(\d+)"
SUPERSESSION = (
    ("full", 0.95, rf"(?i)in\s+supersession\s+of\s+{_NO}"),
    ("full", 0.95, rf"(?i)\bsupersedes?\s+{_NO}"),
    ("full", 0.95, rf"(?i)in\s+place\s+of\s+{_NO}"),
    ("partial", 0.9, rf"(?i)in\s+(?:partial\s+)?modification\s+of\s+{_NO}"),
    ("partial", 0.9, rf"(?i)\bmodifies?\s+{_NO}"),
    ("partial", 0.9, rf"(?i)\bamends?\s+{_NO}"),
)
OWN_NUMBER = r"(?i)^\s*(?:G\.?O\.?\s*M\.?S\.?\s*No\.?)\s*(\d+)"


def supersessions(docs: DataFrame, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """(id, source, target, kind, confidence): the order that a text is, and the orders that it replaces."""

    def found(kind: str, conf: float, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)), lambda x: F.struct(x.cast("int").alias("target"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence")))

    own = F.regexp_extract(text_col, OWN_NUMBER, 1)
    r = docs.select(id_col, F.when(own != "", own).cast("int").alias("source"), F.explode(F.concat(*[found(*s) for s in SUPERSESSION])).alias("r"))
    return r.where("source is not null").select(id_col, "source", "r.*")


def as_of_last(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """The last non-null value at or before each row of its group (a backward as-of join with itself)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
