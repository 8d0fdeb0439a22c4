"""Duplicate detection and resolution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..sources.scratch import shared_folder
from . import set_join

# Signs of an amended version, in a title and in a text.
AMENDED_TITLE = (r"\bamendment\b", r"\bamended\b", r"\bmodification\b", r"\brevised\b", r"\bupdated\b")
AMENDED_TEXT = (r"\bin supersession of\b", r"\bamends?\b", r"\bmodifies?\b", r"\bsubstitutes?\b")
YEAR = r"\b(?:19|20)\d{2}\b"


def duplicate_groups(docs: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys that several rows share, with their number and first and last id; nothing is gathered."""
    return docs.groupBy(key.alias("hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def duplicate_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    g = docs.groupBy(T.content_hash(F.col(text_col)).alias("hash")).agg(F.count("*").alias("n"))
    dup = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return g.agg(F.sum("n").alias("total_documents"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), dup.alias("duplicate_documents"), F.round(dup / F.sum("n"), 6).alias("duplicate_ratio"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b, jaccard) of different texts with character-shingle Jaccard at or above the threshold.

    Exact: copies are represented by their least id; texts of like size are compared by bit sketches, which lose no
    pair, and those that may reach the threshold are verified on the whole sets.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")).groupBy(T.for_comparison(F.col("_t")).alias("norm")).agg(F.min("id").alias("id"))
    pairs = set_join.similar_pairs(base.select("id", "norm"), shared_folder(docs.sparkSession, "near"), threshold)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(F.col("common") / F.col("total"), 6).alias("jaccard"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([round(SequenceMatcher(None, x, y).ratio(), 6) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of the comparison forms; 0 if one is empty. No built-in expresses it."""
    return _ratio(T.for_comparison(a), T.for_comparison(b))


def is_amended(text_a: Column, text_b: Column, title_a: Column, title_b: Column) -> Column:
    title, text = F.lower(F.concat_ws(" ", title_a, title_b)), F.lower(F.concat_ws(" ", text_a, text_b))
    out = F.lit(False)
    for p in AMENDED_TITLE:
        out = out | title.rlike(p)
    for p in AMENDED_TEXT:
        out = out | text.rlike(p)
    return out


def year_of(c: Column) -> Column:
    """The latest year from 1900 to 2030 in a text, else 0."""
    years = F.filter(F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int")), lambda y: y.between(1900, 2030))
    return F.coalesce(F.array_max(years), F.lit(0))


def resolve(docs: DataFrame, keys: list[str], id_col: str, strategy: str = "keep_latest", text_col: str = "text", year: str | None = None) -> DataFrame:
    """One row for each key: the latest, the longest or the first; ``all`` keeps every row."""
    if strategy not in ("keep_latest", "keep_longest", "keep_first"):
        return docs
    when = {"keep_latest": [F.desc_nulls_last(F.col(year) if year else year_of(F.col(text_col)))], "keep_longest": [F.desc(F.length(F.coalesce(F.col(text_col), F.lit(""))))], "keep_first": []}[strategy]
    return docs.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*when, F.col(id_col)))).where("_rn = 1").drop("_rn")


def prefix_dedup(docs: DataFrame, id_col: str, text_col: str, n: int = 500) -> DataFrame:
    """Of texts with equal first ``n`` characters, the one with the least id."""
    best = docs.groupBy(F.md5(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, n)).alias("_h")).agg(F.min(id_col).alias("_keep"))
    return docs.join(best.select("_keep"), docs[id_col] == F.col("_keep"), "left_semi")


def fuzzy_names(df: DataFrame, name_col: str, names: list[str], most: int = 2) -> DataFrame:
    """Rows with every known name within an edit distance; the name list is a literal, so nothing is shuffled."""
    out = df.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("match"))
    return out.withColumn("distance", F.levenshtein(F.lower(name_col), F.lower("match"))).where(F.col("distance") <= most)
