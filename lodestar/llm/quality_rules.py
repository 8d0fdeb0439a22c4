"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once; the ledger keeps each document's measurements and one bit per
failed rule. A policy is a named set of bits, so a new version or an ablation reads the ledger and
never the texts: ``apply_policy`` is one bitwise AND, ``ablation`` one aggregation over the bits.

Words are runs of anything but ASCII white space. Defined results: a null text has no words and
fails ``min_words``; a text without words has no repeated words and no duplicate lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: rule name -> bit. Bits are never reused, so ledgers of different versions stay comparable.
RULES = {"min_words": 0, "repeated_words": 1, "symbol_ratio": 2, "mean_word_length": 3, "duplicate_lines": 4}

#: policy version -> rules whose failure rejects a document.
POLICIES = {
    "base": ("min_words", "repeated_words"),
    "v1": ("min_words", "repeated_words", "symbol_ratio"),
    "v2": ("min_words", "repeated_words", "symbol_ratio", "mean_word_length", "duplicate_lines"),
}


def mask(policy: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _failures() -> dict[str, Column]:
    c = F.col
    return {
        "min_words": c("n_words") < MIN_WORDS,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbol_ratio": 10 * c("n_symbols") > c("n_words"),
        "mean_word_length": (c("n_words") > 0) & ((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
        "duplicate_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and fail_bits (long)."""
    t = F.col("__t")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = d.select(
        "doc_id",
        F.filter(F.split(t, WORD_BREAK + "+"), lambda w: w != "").alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.length(F.regexp_replace(t, WORD_BREAK + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w = lambda i: F.get(F.col("__w"), i)
    # Three-word windows in the order of two hashes: equal ones are neighbours. Words are compared where the hashes agree.
    window = lambda i: F.struct(F.xxhash64(w(i), w(i + 1), w(i + 2)).alias("h"), F.hash(w(i + 2), w(i), w(i + 1)).alias("g"), i.alias("i"))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn("__s", F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0))), window))))
    s = lambda k: F.get(F.col("__s"), k)
    word = lambda x, k: w(x["i"] + k)
    same = lambda x, y: (x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    twice = lambda x, k: F.coalesce(same(x, s(k - 1)), F.lit(False)) | F.coalesce(same(x, s(k + 1)), F.lit(False))
    d = d.withColumn("__p", F.sort_array(F.transform(F.filter("__s", twice), lambda x: x["i"])))
    p = lambda k: F.get(F.col("__p"), k)
    covered = F.aggregate(F.transform("__p", lambda x, k: F.least(F.lit(3), F.coalesce(p(k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    # Always 0, and not deterministic to the optimizer: a filter on a verdict is not pushed below
    # the measurements, where it would evaluate them again for each reference.
    barrier = F.shiftright(F.spark_partition_id(), 31)
    d = d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        (F.coalesce(covered, F.lit(0)) + barrier).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    bits = None
    for name, failed in _failures().items():
        bit = F.when(failed, F.lit(1 << RULES[name])).otherwise(0).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return d.withColumn("fail_bits", bits)


def apply_policy(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    bits = F.col("fail_bits")
    return ledger_df.withColumn("base_failed", bits.bitwiseAND(F.lit(mask("base"))) != 0).withColumn("kept", bits.bitwiseAND(F.lit(mask(policy))) == 0).withColumn("policy", F.lit(policy))


def ablation(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of the policy: documents that fail it, and those kept if that rule alone were dropped."""
    m = mask(policy)
    hit = F.col("fail_bits").bitwiseAND(F.lit(m))
    stats = ledger_df.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))  # at most 2**rules rows
    rules = ledger_df.sparkSession.createDataFrame([(r, 1 << RULES[r]) for r in POLICIES[policy]], "rule string, bit long")
    return (
        stats.join(F.broadcast(rules), F.col("hit").bitwiseAND(F.col("bit")) != 0)
        .groupBy("rule", "bit")
        .agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_only_this"))
    )


def keep_good(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns; no join, the row travels with its verdict."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    verdict = apply_policy(ledger(carried, "__row", f"__row.`{text_col}`"), policy)
    return verdict.where("kept").select("doc_id.*")
