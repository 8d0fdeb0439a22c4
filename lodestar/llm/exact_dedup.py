"""Exact dedup: groups by a 128-bit content hash, proves each group by its bytes, keeps one stable id.

1. ``groupBy(md5, text)`` with map-side combine: a group of copies sends one row per map task,
   however many rows it has, and equality inside a hash value is decided on the bytes themselves.
2. Each document finds its group by (md5, sha-256) without moving its text; that join's large
   keys are split by adaptive execution. Should two different texts ever share both digests,
   those documents alone join on the text as well.

Defined results: a null text is the empty text; a null id never wins against an id; rows that
repeat an id are one document and share the verdict; an empty table gives an empty result.
The id that stays is the smallest by default, the largest with ``keep="max"``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col("text").cast("binary")
    return texts(docs, id_col, text_col).withColumn("h", F.unhex(F.md5(t))).withColumn("sha", F.unhex(F.sha2(t, 256)))


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    best = F.max if keep == "max" else F.min
    d = _digests(docs, id_col, text_col)
    by_bytes = d.groupBy("h", "sha", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(by_bytes.withColumn("bytes_md5_clash", F.lit(False)).drop("text", "bytes_md5_clash"), "exact-groups")
    per_key = groups.groupBy("h", "sha").agg(F.count("*").alias("n_texts"))
    clash = per_key.where("n_texts > 1")
    light = d.drop("text")
    if clash.isEmpty():
        joined = light.join(groups, ["h", "sha"])
    else:  # two texts behind one pair of digests: their bytes join too
        sure = light.join(groups.join(clash, ["h", "sha"], "left_anti"), ["h", "sha"])
        apart = d.join(clash, ["h", "sha"], "left_semi").join(by_bytes, ["h", "sha", "text"])
        joined = sure.unionByName(apart.select(sure.columns))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each distinct text.

    The whole row travels with the group's aggregate, so texts move once and nothing is joined
    back. Of rows with equal text and id, one stays; a row that stays keeps a null text as null.
    """
    best = F.max_by if keep == "max" else F.min_by
    t = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    order = F.struct(F.col(id_col).isNotNull() if keep == "max" else F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNotNull())
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.col(text_col).isNull().alias("__no_text"))
    g = docs.groupBy(F.md5(t.cast("binary")).alias("__h"), t.alias("__t")).agg(best(row, order).alias("__row"))
    text = F.when(~F.col("__row.__no_text"), F.col("__t")).alias(text_col)
    return g.select(*[text if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
