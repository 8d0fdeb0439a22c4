"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..streaming import events as S
from . import corpus

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("w01_tumbling_usage", "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    return S.usage(corpus.table(spark, sf, "events")).withColumn("value", F.round("value", 4))


@query("w02_sliding_usage", "WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts::TIMESTAMP), time_bucket(INTERVAL 30 MINUTE, ts::TIMESTAMP) - INTERVAL 30 MINUTE]) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY 1, 2")
def _(spark, sf):
    return S.usage(corpus.table(spark, sf, "events"), "1 hour", "30 minutes").withColumn("value", F.round("value", 4))


@query("w03_sessions", "WITH l AS (SELECT user_id, ts::TIMESTAMP AS ts, lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, sf):
    return S.sessions(corpus.table(spark, sf, "events"))


@query("s19_latest_by_key", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1")
def _(spark, sf):
    return io.latest(corpus.table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("s20_collection_counts", "SELECT event_type AS collection, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return io.collection_counts(corpus.table(spark, sf, "events").withColumnRenamed("event_type", "collection"))


@query("s25_resume_unprocessed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def _(spark, sf):
    done = corpus.table(spark, sf, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return io.unprocessed(corpus.table(spark, sf, "orders"), done, "o_orderkey").select("o_orderkey")


@query("s24_usage_json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def _(spark, sf):
    e = corpus.table(spark, sf, "events")
    key = F.element_at(F.json_object_keys("props"), 1)
    return e.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), key).alias("first_value"))


@query("x04_group_by_type", f"{corpus.WITH} SELECT coalesce(CASE WHEN kind = 5 THEN NULL ELSE doc_type END, CASE WHEN pos = 1 THEN title END, 'external') AS kind_name, count(*) AS n FROM chunks GROUP BY 1")
def _(spark, sf):
    c = corpus.chunks(spark, sf)
    return c.groupBy(F.coalesce(F.when(F.col("kind") != 5, F.col("doc_type")), F.when(F.col("pos") == 1, F.col("title")), F.lit("external")).alias("kind_name")).agg(F.count("*").alias("n"))


@query("x02_union_of_sources", "SELECT role AS source, count(*) AS n FROM conversations GROUP BY 1 UNION ALL SELECT lang, count(*) FROM documents GROUP BY 1")
def _(spark, sf):
    a = corpus.table(spark, sf, "conversations").select(F.col("role").alias("source"))
    return a.unionByName(corpus.table(spark, sf, "documents").select(F.col("lang").alias("source"))).groupBy("source").agg(F.count("*").alias("n"))
