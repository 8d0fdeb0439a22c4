"""Aggregations over chunks, data points, orders, cases and schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric -> patterns, in the order in which they are looked for.
METRICS = {
    "enrollment": r"(?i)(?:total\s+)?enrollment|number of students",
    "ptr": r"(?i)pupil[- ]teacher ratio|PTR|student[- ]teacher ratio",
    "dropout_rate": r"(?i)dropout rate|drop[- ]out",
    "retention_rate": r"(?i)retention rate",
    "transition_rate": r"(?i)transition rate",
    "pass_percentage": r"(?i)pass percentage|pass rate",
    "ger": r"(?i)gross enrollment ratio|GER",
    "ner": r"(?i)net enrollment ratio|NER",
}
DISTRICTS = ("Anantapur", "Chittoor", "East Godavari", "Guntur", "Krishna", "Kurnool", "Nellore", "Prakasam", "Srikakulam", "Visakhapatnam", "Vizianagaram", "West Godavari", "YSR Kadapa")
CATEGORIES = ("SC", "ST", "OBC", "BC", "EWS", "Minority", "General")
RATIO, NUMBER = r"(\d+(?:\.\d+)?):(\d+)", r"\d+(?:,\d+)*(?:\.\d+)?"
AMENDMENT = r"(?i)\bamendment\b|\bamends\b|\bamended\b|\bin supersession\b|\bsubstituted\b"
CASE_STATUS = (("decided", r"(?i)decided|disposed|allowed|dismissed"), ("pending", r"(?i)pending|reserved|admitted"), ("interim", r"(?i)interim|stay|injunction"))


def first_district(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(c).contains(d.lower()), F.lit(d)) for d in DISTRICTS])


def first_category(c: Column) -> Column:
    return F.coalesce(*[F.when(c.rlike(rf"(?i)\b{k}\b"), F.lit(k)) for k in CATEGORIES])


def report_year(c: Column) -> Column:
    a, b = F.regexp_extract(c, r"(\d{4})-?(\d{2})", 1), F.regexp_extract(c, r"(\d{4})-?(\d{2})", 2)
    one = F.regexp_extract(c, r"\b(20\d{2})\b", 1)
    return F.when(a != "", F.concat(a, F.lit("-"), b)).when(one != "", one)


def numeric_value(c: Column) -> dict[str, Column]:
    """value, unit: a ratio a:b before a plain number, which crore and lakh multiply (crore first)."""
    ratio, raw = F.regexp_extract(c, RATIO, 0), F.regexp_extract(c, NUMBER, 0)
    plain = F.regexp_replace(raw, ",", "").try_cast("double")
    crore, lakh = F.lower(c).contains("crore"), F.lower(c).contains("lakh")
    percent = c.rlike(NUMBER + r"\s*%")
    return {
        "value": F.when(ratio != "", F.regexp_extract(c, RATIO, 1).try_cast("double") / F.regexp_extract(c, RATIO, 2).try_cast("double")).when(crore, plain * 1e7).when(lakh, plain * 1e5).otherwise(plain),
        "unit": F.when(ratio != "", "ratio").when(crore, "crore").when(lakh, "lakh").when(percent, "percentage"),
    }


def data_points(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, sentence number, metric, value, unit, year, district): a row for each metric of each sentence with a number."""
    s = chunks.select(id_col, F.posexplode(F.split(text_col, r"[.!?]\s+")).alias("sentence_no", "sentence"), F.col(text_col).alias("_t"))
    found = F.filter(F.array(*[F.when(F.col("sentence").rlike(p), F.lit(m)) for m, p in METRICS.items()]), lambda x: x.isNotNull())
    v = numeric_value(F.col("sentence"))
    return (
        s.select(id_col, "sentence_no", "sentence", "_t", F.explode(found).alias("metric"))
        .select(id_col, "sentence_no", "metric", v["value"].alias("value"), v["unit"].alias("unit"), report_year(F.col("_t")).alias("year"), first_district(F.col("_t")).alias("district"))
        .where("value is not null")
    )


def metric_catalog(points: DataFrame) -> DataFrame:
    return points.groupBy("metric").agg(F.count("*").alias("n_points"), F.min_by("unit", F.struct("chunk_id", "sentence_no")).alias("unit"), F.countDistinct("year").alias("n_years"))


def time_series(points: DataFrame) -> DataFrame:
    """A value for each metric and year: the sum for enrollment, else the mean; zeros and nulls do not count."""
    p = points.where("value is not null and value <> 0 and year is not null")
    return p.groupBy("metric", "year").agg(F.when(F.first("metric") == "enrollment", F.sum("value")).otherwise(F.avg("value")).alias("value"), F.count("*").alias("n"))


def breakdown(points: DataFrame, by: str) -> DataFrame:
    """The last value of each metric in each ``by`` (by chunk and sentence)."""
    return points.where(F.col(by).isNotNull()).groupBy(by, "metric").agg(F.max_by("value", F.struct("chunk_id", "sentence_no")).alias("value"))


def order_status(orders: DataFrame, superseded: DataFrame, id_col: str, year_col: str, as_of: int, has_info: Column) -> DataFrame:
    """superseded, active (it replaces others), likely_superseded (older than ten years), else active."""
    s = superseded.select(F.col("target").alias(id_col), F.lit(True).alias("_gone")).distinct()
    status = F.when(F.col("_gone"), "superseded").when(has_info, "active").when(as_of - F.col(year_col) > 10, "likely_superseded").otherwise("active")
    return orders.join(s, id_col, "left").withColumn("status", status).drop("_gone")


def amendment_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("substituted"), "substitution").when(low.contains("inserted") | low.contains("added"), "insertion").when(low.contains("omitted") | low.contains("deleted"), "deletion").when(low.contains("supersession"), "supersession").otherwise("modification")


def top_sections(chunks: DataFrame, pattern: str, k: int = 10) -> DataFrame:
    """The k sections of highest weight (two for each chunk, one for each mention) of each document type."""
    r = chunks.select("doc_type", "chunk_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("section"))
    s = r.groupBy("doc_type", "section").agg((2 * F.countDistinct("chunk_id") + F.count("*")).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("doc_type").orderBy(F.desc("weight"), "section"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def case_status(c: Column) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p in CASE_STATUS], F.lit("unknown"))


def budget_crore(c: Column) -> Column:
    """The first amount of a text in crores: lakhs are a hundredth, thousands a ten-thousandth."""
    n = F.regexp_replace(F.regexp_extract(c, r"(?i)(\d+(?:,\d+)*(?:\.\d+)?)\s*(crore|lakh|thousand)", 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(c, r"(?i)(\d+(?:,\d+)*(?:\.\d+)?)\s*(crore|lakh|thousand)", 2))
    return F.when(unit == "crore", n).when(unit == "lakh", n / 100).when(unit == "thousand", n / 10000)


def co_occurrence(entities: DataFrame, group: str, value: str, least: int, k: int = 20) -> DataFrame:
    """The k most frequent pairs of values in a group, seen at least ``least`` times, with confidence min(n / 10, 0.9).

    Values of one group are few (a chunk's entities); the pairs are aggregated before they move.
    """
    e = entities.select(group, value).distinct()
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{value}") < F.col(f"b.{value}"))).groupBy(F.col(f"a.{value}").alias("left_value"), F.col(f"b.{value}").alias("right_value")).agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= least).withColumn("confidence", F.least(F.col("n") / 10, F.lit(0.9))).orderBy(F.desc("n"), "left_value", "right_value").limit(k)


def rule_hierarchy(df: DataFrame, group: str, text_col: str, pattern: str = r"(?i)Rule\s+(\d+)") -> DataFrame:
    """(group, n_rules, first_rule, last_rule) over the distinct rules that its texts name."""
    r = df.select(group, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("rule")).distinct()
    return r.groupBy(group).agg(F.count("*").alias("n_rules"), F.min(F.col("rule").cast("int")).alias("first_rule"), F.max(F.col("rule").cast("int")).alias("last_rule"))


def subject_index(df: DataFrame, id_col: str, text_col: str, subjects) -> DataFrame:
    """(subject, n, first_chunk): texts that name each subject."""
    low = F.lower(F.col(text_col))
    s = df.select(id_col, F.explode(F.filter(F.array(*[F.lit(k) for k in subjects]), lambda k: F.contains(low, k))).alias("subject"))
    return s.groupBy("subject").agg(F.count("*").alias("n"), F.min(id_col).alias("first_chunk"))


def topic_chunks(df: DataFrame, topic: str, id_col: str, score_col: str, k: int = 20) -> DataFrame:
    """(topic, chunk_ids): of each topic the ids of its ``k`` best chunks, best first, joined by commas."""
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc(score_col), id_col))
    best = df.withColumn("_rank", rank).where(F.col("_rank") <= k)
    g = best.groupBy(topic).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(id_col).cast("string").alias("id")))).alias("c"))
    return g.select(topic, F.array_join(F.transform("c", lambda x: x["id"]), ",").alias("chunk_ids"))
