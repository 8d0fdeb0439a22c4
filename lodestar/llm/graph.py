"""Connected components of an undirected edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-step of the alternating star algorithm: links each node's neighbours to its least neighbour.

    A node with very many neighbours is a hot key of an aggregation with map-side combine and of
    a join whose skew adaptive execution splits; its neighbours are never gathered in a list.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); a component is named by its least node.

    Each round is written to the shared folder. A forest of stars, which most inputs are, needs
    one round to see that nothing changes.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    spark = edges.sparkSession
    while True:
        # Done when every node has one edge and no root is itself attached.
        state = now.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        many = state.where("n > 1").limit(1).count()
        if not many and now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0:
            break
        new = materialize(_star(_star(now, True), False), tag)
        remove(spark, now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
