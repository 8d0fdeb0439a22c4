"""Checking the names and years that a query gave against dictionaries, at the size of tables.

A name that is no entry is compared with the entries that it can be a slip of. Two names meet if a token of one, or
the whole without spaces, becomes one of the other by leaving out a third of its letters, at most three, of words beyond
``SHORT`` letters two, on either side (so three letters lost, added or changed in a token); they meet by an equi-join on these shortened forms, so no
dictionary is broadcast and no pair is tried that shares none. Pairs are then scored exactly. Each different name is
looked up once, however many queries give it.

Scores are those of letters in common order (twice the longest common subsequence over both lengths, in percent), plain
or over sets of tokens, on lower-case forms with white space for punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHORT, THRESHOLD = 16, 80
MOST_DISTRICTS = 3
#: Severity of a name that matches nothing; a metric then passes.
INVALID = {"district": "error", "scheme": "warning"}
#: Rows of a batch that a task emits: a long name has a thousand keys.
ROWS = 20_000
#: Kinds whose names are compared as sets of tokens.
BY_TOKENS = ("scheme", "metric")


_OTHER = re.compile(r"\W")


def form(name: str) -> str:
    return _OTHER.sub(" ", name.lower()).strip()


def shortened(word: str) -> set[str]:
    """The word and what is left of it when letters are left out."""
    out = {word}
    for k in range(1, min(3 if len(word) <= SHORT else 2, len(word) // 3) + 1):
        for gone in combinations(range(len(word)), k):
            at = [-1, *gone, len(word)]
            out.add("".join(word[i + 1 : j] for i, j in zip(at, at[1:], strict=False)))
    return out


def keys(name: str) -> set[str]:
    """The forms by which names meet."""
    f = form(name)
    return set().union(*(shortened(w) for w in {*f.split(), "".join(f.split())}))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> int:
    """0 to 100, halves up; 0 where one is empty."""
    return int(200 * common(a, b) / (len(a) + len(b)) + 0.5) if a and b else 0


def token_set_ratio(a: str, b: str) -> int:
    """The best ratio among the shared tokens and these with the rest of either name."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(rest))}".strip() for rest in (x - y, y - x))
    return max(ratio(both, one), ratio(both, two), ratio(one, two))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, name, key) of batches of (kind, name), at most ``ROWS`` rows at once."""
    for b in batches:
        rows = ((k, n, key) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for key in keys(n))
        while part := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names=["kind", "name", "key"])


def with_keys(names: DataFrame) -> DataFrame:
    """(kind, name, key) of names (kind, name)."""
    return names.select("kind", "name").where(F.col("name").isNotNull()).mapInArrow(keyed, "kind string, name string, key string")


def scores(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(token_set_ratio if k in BY_TOKENS else ratio)(form(x), form(y)) for k, x, y in zip(kind, a, b, strict=True)], dtype="int32")


def closest(names: DataFrame, dictionary: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(kind, name, match, score): for names (kind, name) the best entry (kind, name) at the threshold or above, of equal ones the first by name."""
    # Names and pairs are small rows and much work: a fixed number of partitions, which adaptive execution leaves as it is.
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = with_keys(names.select("kind", "name").distinct().repartition(parts, F.xxhash64("kind", "name")))  # by a hash: a plain repartition after distinct is left out
    e = with_keys(dictionary.select("kind", "name").distinct()).withColumnRenamed("name", "match")
    pairs = n.join(e, ["kind", "key"]).select("kind", "name", "match").distinct()
    pairs = pairs.repartition(parts, "kind", "name")
    near = pairs.withColumn("score", F.pandas_udf(scores, "int")("kind", "name", "match")).where(F.col("score") >= threshold)
    best = F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.desc("score"), "match"))
    return near.withColumn("_rn", best).where("_rn = 1").select("kind", "name", "match", "score")


def validate(entities: DataFrame, queries: DataFrame, dictionary: DataFrame, first_year: int = 2010, last_year: int = 2025, threshold: int = THRESHOLD) -> DataFrame:
    """(qid, kind, value, issue, severity, suggestion, score): what is wrong with the entities (qid, kind, value) of queries (qid, text).

    typo_corrected, invalid_entity, out_of_range and invalid_format of academic years (kind ``date``), possible_hallucination of a
    district (corrected where it was) that the text does not name, excessive_entities of more than three districts. What has no issue gives no row.
    """
    null = F.lit(None).cast("string")
    e = entities.select("qid", "kind", "value")
    named = e.where(F.col("kind") != "date")
    known = dictionary.select("kind", F.col("name").alias("value")).distinct()
    distinct = named.select("kind", "value").distinct().join(known, ["kind", "value"], "left_anti").withColumnRenamed("value", "name")
    found = distinct.join(closest(distinct, dictionary, threshold), ["kind", "name"], "left").withColumnRenamed("name", "value")
    wrong = named.join(found, ["kind", "value"])
    severity = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in INVALID.items()])
    names = wrong.select(
        "qid", "kind", "value", F.when(F.col("match").isNotNull(), "typo_corrected").otherwise("invalid_entity").alias("issue"),
        F.when(F.col("match").isNotNull(), F.lit("info")).otherwise(severity).alias("severity"), F.col("match").alias("suggestion"), "score",
    ).where(F.col("severity").isNotNull())
    year = F.regexp_extract("value", r"^\s*([+-]?\d+)\s*(?:-|$)", 1).try_cast("int")
    dates = e.where("kind = 'date'").select(
        "qid", "kind", "value", F.when(year.isNull(), "invalid_format").when(~year.between(first_year, last_year), "out_of_range").alias("issue"),
        F.when(year.isNull(), "error").otherwise("warning").alias("severity"), F.when(year.isNotNull(), f"{first_year}-{last_year}").alias("suggestion"), F.lit(None).cast("int").alias("score"),
    ).where(F.col("issue").isNotNull())
    districts = named.where("kind = 'district'").join(found, ["kind", "value"], "left").select("qid", "kind", F.coalesce("match", "value").alias("value"))
    text = queries.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    absent = districts.join(text, "qid").where(~F.contains("_low", F.lower("value")))
    absent = absent.select("qid", "kind", "value", F.lit("possible_hallucination").alias("issue"), F.lit("warning").alias("severity"), null.alias("suggestion"), F.lit(None).cast("int").alias("score"))
    many = named.where("kind = 'district'").groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > MOST_DISTRICTS)
    many = many.select("qid", F.lit("district").alias("kind"), F.col("n").cast("string").alias("value"), F.lit("excessive_entities").alias("issue"), F.lit("warning").alias("severity"), null.alias("suggestion"), F.lit(None).cast("int").alias("score"))
    return names.unionByName(dates).unionByName(absent).unionByName(many)


def validity(issues: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, is_valid, n_errors, n_warnings, n_corrections) of every query."""
    n = issues.groupBy("qid").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.count_if(F.col("issue") == "typo_corrected").alias("n_corrections"))
    j = queries.select("qid").join(n, "qid", "left").na.fill(0, ["n_errors", "n_warnings", "n_corrections"])
    return j.select("qid", (F.col("n_errors") == 0).alias("is_valid"), "n_errors", "n_warnings", "n_corrections")
