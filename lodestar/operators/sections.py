"""Sectioning and chunking: texts to rows.

Splitting at headings is one regular-expression split in the JVM. Greedy packing with carried state
is a fold over the parts of one text; both stay inside a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings by document type.
ACT_HEADING = r"(?i)Section\s+\d+[A-Z]?\.?\s*[-:]?\s*[^\n]*"
ACT_SPLIT = r"(?i)(?=\bSection\s+\d+[A-Z]?[^\n]*\n)"
JUDICIAL_HEADERS = ("FACTS", "ISSUES", "ARGUMENTS", "HELD", "JUDGMENT", "ORDER", "CONCLUSION", "RATIO", "BACKGROUND")
LEGAL_TERMS = ("shall", "must", "required", "mandatory", "prohibited", "entitled")


def split_at(text: Column, heading: str) -> Column:
    """Array of (title, body) from one heading match to the next; what precedes the first is dropped."""
    marked = F.regexp_replace(text, F.lit(rf"({heading})"), F.lit("\u0001$1\u0002"))
    parts = F.slice(F.split(marked, "\u0001"), F.lit(2), F.lit(1 << 20))
    return F.transform(parts, lambda p: F.struct(F.regexp_replace(F.substring_index(p, "\u0002", 1), r"^\s+|\s+$", "").alias("title"), F.regexp_replace(F.regexp_replace(F.substring_index(p, "\u0002", -1), r"^\s+", ""), r"\s+$", "").alias("body")))


def act_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, section_id, section_title, text, char_count); a text without sections is one, ``full_text``."""
    s = split_at(F.col(text_col), ACT_HEADING)
    whole = F.array(F.struct(F.lit("Full Document").alias("title"), F.col(text_col).alias("body")))
    rows = df.select(id_col, F.posexplode(F.when(F.size(s) > 0, s).otherwise(whole)).alias("position", "s"))
    number = F.regexp_extract("s.title", r"(?i)Section\s+(\d+[A-Z]?)", 1)
    return rows.select(id_col, "position", F.when(number != "", F.concat(F.lit("sec_"), number)).otherwise("full_text").alias("section_id"), F.col("s.title").alias("section_title"), F.col("s.body").alias("text"), F.length("s.body").alias("char_count"))


def numbered_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Numbered paragraphs where there are two or more, else the whole text."""
    s = split_at(F.concat(F.lit("\n"), F.col(text_col)), r"\n\d+\.\s+[^\n]*")
    whole = F.array(F.struct(F.lit("Government Order").alias("title"), F.col(text_col).alias("body")))
    rows = df.select(id_col, F.posexplode(F.when(F.size(s) >= 2, s).otherwise(whole)).alias("position", "s"))
    number = F.regexp_extract("s.title", r"^\s*(\d+)\.", 1)
    return rows.select(id_col, "position", F.when(number != "", F.concat(F.lit("para_"), number)).otherwise("full_text").alias("section_id"), F.substring("s.title", 1, 100).alias("section_title"), F.col("s.body").alias("text"))


def pack_parts(parts: Column, most: int, glue: str, overlap: int = 0) -> Column:
    """Greedy packing of an array of texts: a part that would pass ``most`` characters starts a new text.

    ``overlap`` characters of the finished text lead the next one.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        now = acc["now"]
        full = now.isNotNull() & (F.length(now) + F.length(p) > most)
        tail = F.concat(F.substr(now, F.greatest(F.lit(1), F.length(now) - overlap + 1), F.lit(overlap)), F.lit(glue), p) if overlap else p
        return F.struct(
            F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"),
            F.when(full, tail).when(now.isNull(), p).otherwise(F.concat(now, F.lit(glue), p)).alias("now"),
        )

    folded = F.aggregate(parts, start, step)
    return F.when(folded["now"].isNull(), folded["done"]).otherwise(F.array_append(folded["done"], folded["now"]))


def generic_sections(df: DataFrame, id_col: str, text_col: str, most: int = 5000) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(id_col, F.posexplode(pack_parts(parts, most, "\n\n")).alias("position", "text"))


def general_chunks(df: DataFrame, id_col: str, text_col: str, most: int = 1000, overlap: int = 100, separator: str = "\n\n") -> DataFrame:
    """Paragraphs packed to at most ``most`` characters, each chunk led by the end of the one before."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), separator), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(id_col, F.posexplode(pack_parts(parts, most, "\n\n", overlap)).alias("position", "text"))


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[.!?])\s+"), lambda p: p != "")
    return df.select(id_col, F.posexplode(pack_parts(parts, most, " ", overlap)).alias("position", "text"))


def importance(text: Column, chunk_type: Column, n_references: Column | None = None) -> Column:
    """A tenth for each legal term that occurs, a bonus by type and for 100 to 500 words, references up to 0.3; at most 1."""
    low = F.lower(text)
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    score = sum((F.when(low.contains(t), 0.1).otherwise(0.0) for t in LEGAL_TERMS), F.lit(0.0))
    score += F.when(chunk_type.isin("legal_section", "go_order"), 0.3).when(chunk_type.isin("judicial_holding", "data_summary"), 0.2).otherwise(0.0) + F.when(n.between(100, 500), 0.2).otherwise(0.0)
    if n_references is not None:
        score += F.least(n_references * 0.1, F.lit(0.3))
    return F.least(score, F.lit(1.0))


def order_part(line: Column) -> Column:
    """0 to 3 for what a line announces: header, preamble, orders, annexures."""
    low = F.lower(line)
    return F.when(low.rlike(r"annexure"), 3).when(low.rlike(r"it is hereby ordered|now therefore|orders?\b"), 2).when(low.rlike(r"whereas|in exercise of|having considered"), 1).otherwise(0)


def order_parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of an order with the part that they are in: header, preamble, orders, annexures; the state only moves on."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    state = order_part(F.col("line"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.element_at(F.array(*[F.lit(x) for x in ("header", "preamble", "orders", "annexures")]), F.max(state).over(w) + 1)
    return lines.withColumn("part", part)


def merge_small(df: DataFrame, group: str, order: str, text_col: str, key: str, least_words: int = 50) -> DataFrame:
    """Joins a chunk of fewer than ``least_words`` words to its successor where both have the same key.

    A run of small chunks pairs up from its start; a small chunk without such a successor stays
    (nothing is dropped).
    """
    w = Window.partitionBy(group).orderBy(order)
    n = F.size(F.filter(F.split(text_col, r"\s+"), lambda x: x != ""))
    d = df.withColumn("_small", n < least_words).withColumn("_joins", F.col("_small") & (F.lead(key).over(w) == F.col(key)))
    run = F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_run", F.coalesce(run, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group, "_run").orderBy(order)) - 1
    d = d.withColumn("_pair", F.floor(place / 2))
    g = d.groupBy(group, "_run", "_pair").agg(F.min(order).alias(order), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))).alias("p"), F.min_by(key, order).alias(key))
    return g.select(group, order, key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias(text_col), F.size("p").alias("n_merged"))
