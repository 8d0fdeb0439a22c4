"""Extraction of references, entities, relations and dates from text, as columns and row generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dictionaries import DISTRICTS, EDUCATION_LEVELS, SCHEMES, SCHOOL_TYPES, SOCIAL_CATEGORIES, any_of
from .text import may_match

# Patterns by kind. Whole matches are kept, white space collapsed, repeats dropped.
SIMPLE = {
    "legal_refs": (
        r"(?i)\bSection\s+(?:\d+)(?:\s*\(\s*(?:\d+)\s*\))?(?:\s*\(\s*(?:[a-z]+)\s*\))?", r"(?i)\bSec\.?\s+(?:\d+)(?:\s*\(\s*(?:\d+)\s*\))?", r"(?i)\bArticle\s+(?:\d+)(?:\s*(?:[A-Z]+))?", r"(?i)\bArt\.?\s+(?:\d+)(?:\s*(?:[A-Z]+))?",
        r"(?i)\bRule\s+(?:\d+)(?:\s*\(\s*(?:\d+)\s*\))?", r"(?i)\bR\.?\s+(?:\d+)", r"(?i)\bClause\s+(?:\d+)", r"(?i)\bChapter\s+(?:[IVX]+|\d+)",
    ),
    "metrics": (
        r"(?i)\b(?:gross enrollment ratio|GER)\b", r"(?i)\b(?:net enrollment ratio|NER)\b", r"(?i)\b(?:pupil[- ]teacher ratio|PTR|student[- ]teacher ratio)\b", r"(?i)\b(?:dropout rate|drop[- ]out)\b", r"(?i)\b(?:retention rate)\b",
        r"(?i)\b(?:transition rate)\b", r"(?i)\b(?:pass percentage|pass rate)\b", r"(?i)\b(?:learning outcome|learning outcomes)\b", r"(?i)\b(?:enrollment|enrolment)\b",
    ),
    "schemes": (any_of(SCHEMES),),
    "districts": (any_of(DISTRICTS),),
    "social_categories": (any_of(SOCIAL_CATEGORIES),),
    "school_types": (any_of(SCHOOL_TYPES),),
    "education_levels": (any_of(EDUCATION_LEVELS),),
    "acronyms": (r"\b[A-Z]{3,5}\b",),
    "amounts": (r"(?i)(?:Rs|INR)\.?\s*\d+(?:,\d+)*(?:\.\d+)?\s*(?:crore|lakh|thousand)s?",),
    "definitions": (r'(?i)"[^"]+"\s+means\s+[^.]+',),
    "effective_dates": (r"(?i)\b(?:with effect from|w\.?e\.?f\.?)\s+[^.,;]+",),
    "case_parties": (r"[A-Z][A-Za-z ]+\d* vs\. [A-Z][A-Za-z ]+",),
}
ORDER_PATTERN = r"(?i)(?:G\.O\.|GO|G\.O|Ms\.No\.|MS\s+No\.|Rt\.No\.|RT\s+No\.)\s*(?:MS|RT|No\.?)?\.?\s*(?:No\.?)?\s*(\d+)(?:\s*/\s*(\d{4})|\s+dated?\s+(\d{1,2}[\./-]\d{1,2}[\./-]\d{2,4})|\s+dt\.?\s+(\d{1,2}[\./-]\d{1,2}[\./-]\d{2,4}))?"
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "this", "that", "these", "those", "it", "its", "as", "will", "shall",
)
#: (kind, confidence, pattern, group of the target).
RELATIONS = (
    ("cites", 0.9, r"(?i)(?:as per|under|in|pursuant to|according to|by virtue of)\s+((?:Section|Sec\.|Article|Art\.|Rule|Clause)\s+\d+)", 1),
    ("cites", 0.9, r"(?i)in terms of\s+((?:Section|Sec\.|Article|Art\.|Rule)\s+\d+)", 1),
    ("cites", 0.9, r"(?i)as per\s+((?:G\.O\.|GO)\.?(?:MS|RT)?\.?\s*No\.?\s*\d+)", 1),
    ("implements", 0.9, r"(?i)implement(?:s|ing)?\s+(?:the provisions of\s+)?((?:Section|Sec\.|Article|Rule)\s+\d+)", 1),
    ("supersedes", 0.95, r"(?i)supersedes?\s+(?:the\s+)?((?:G\.O\.|GO)(?:MS|RT)?\.?\s*No\.?\s*\d+)", 1),
    ("supersedes", 0.95, r"(?i)in supersession of\s+(?:the\s+)?((?:G\.O\.|GO)(?:MS|RT)?\.?\s*No\.?\s*\d+)", 1),
    ("amends", 0.9, r"(?i)amends?\s+(?:the\s+)?((?:Section|Sec\.|Article|Rule)\s+\d+)", 1),
    ("defines", 0.85, r'(?i)"([^"]+)"\s+means\b', 1),
    ("mandates", 0.9, r"(?i)((?:Section|Sec\.|Article|Rule)\s+\d+)\s+(?:mandates?|requires?|stipulates?|prescribes?)", 1),
    ("allocates", 0.8, r"(?i)allocated\s+(?:for|to|under)\s+([A-Z][A-Za-z -]+(?:Scheme|Programme|Project))", 1),
    ("applies_to", 0.8, r"(?i)in\s+([A-Z][a-z]+)\s+district", 1),
)
GRAPH_ENTITIES = {
    "government_order": (r"G\.?O\.?\s*(?:Ms\.?|Rt\.?)?\s*No\.?\s*(\d+)", r"Government\s+Order.*?No\.?\s*(\d+)"),
    "legal_section": (r"Section\s+(\d+(?:\([a-z]\))?)", r"Article\s+(\d+)", r"Rule\s+(\d+)", r"Chapter\s+(\d+)"),
    "act": (r"(Right\s+to\s+Education\s+Act)", r"(RTE\s+Act)"),
    "scheme": (r"(Nadu[\-\s]?Nedu)", r"(Amma\s+Vodi)", r"(Mid[\-\s]?Day[\-\s]?Meal)", r"(Sarva\s+Shiksha\s+Abhiyan)"),
    "district": (r"([A-Z][a-z]+)\s+district",),
    "date": (r"(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{4})", r"(\d{1,2}(?:st|nd|rd|th)?\s+[A-Z][a-z]+\s+\d{4})"),
}
FORMAL, HEDGED = r"hereby|whereas|provided|shall", r"may|might|could|similar"
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}
_MONTH = "(" + "|".join(MONTHS) + ")"
DATE_DMY = r"\b(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})\b"
DATE_PATTERNS = (  # pattern, groups of year, month, day
    (DATE_DMY, 3, 2, 1),
    (r"\b(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})\b", 1, 2, 3),
    (rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\s+(\d{{4}})\b", 3, 2, 1),
    (rf"(?i)\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", 3, 1, 2),
    (rf"(?i)\b(\d{{4}})\s+{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b", 1, 2, 3),
)
ACADEMIC_YEAR = r"(?i)\b(?:AY|Academic Year|FY|Financial Year)?\s*(\d{4})-(\d{2,4})\b"


def matches(text: Column, patterns) -> Column:
    """Distinct whole matches of all patterns, white space collapsed."""
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(~may_match(text, p), none).otherwise(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in patterns])
    return F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def order_references(text: Column) -> Column:
    """Government orders as ``G.O.MS.No. N``, with ``/year`` or `` dated d.m.y`` where given; distinct."""

    def form(m: Column) -> Column:
        n, y, a, b = (F.regexp_extract(m, ORDER_PATTERN, i) for i in range(1, 5))
        tail = F.when(y != "", F.concat(F.lit("/"), y)).when(a != "", F.concat(F.lit(" dated "), a)).when(b != "", F.concat(F.lit(" dated "), b)).otherwise("")
        return F.concat(F.lit("G.O.MS.No. "), n, tail)

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ORDER_PATTERN), F.lit(0)), form))


def keywords(docs: DataFrame, top_n: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The most frequent words of four letters or more of each document; ties by first appearance."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    w = docs.select(id_col, F.posexplode(tokens).alias("pos", "word")).where(F.col("word").rlike("^[a-z]{4,}$") & ~F.col("word").isin(*STOP_WORDS))
    k = w.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))
    return k.withColumn("rank", rank).where(F.col("rank") <= top_n).drop("first")


def relations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, relation_type, target, confidence, n): distinct relations by type and lower-case target."""

    def found(kind: str, conf: float, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("relation_type"), F.lower(x).alias("target"), F.lit(conf).alias("confidence")))

    each = [found(*r) for r in RELATIONS]
    r = docs.select(id_col, F.explode(F.concat(*each)).alias("r")).select(id_col, "r.*")
    return r.groupBy(id_col, "relation_type", "target").agg(F.min("confidence").alias("confidence"), F.count("*").alias("n"))


def graph_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity_type, value, confidence); the context that moves a confidence is the whole chunk."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("value")))

    each = [found(kind, p) for kind, pats in GRAPH_ENTITIES.items() for p in pats]
    e = docs.select(id_col, F.lower(text_col).alias("_low"), F.explode(F.concat(*each)).alias("e")).select(id_col, "_low", "e.*")
    low = F.col("_low")
    conf = 0.8 + F.when(low.rlike(FORMAL), 0.1).otherwise(0.0) + F.when((F.col("entity_type") == "legal_section") & low.contains("section"), 0.1).otherwise(0.0) - F.when(low.rlike(HEDGED), 0.1).otherwise(0.0)
    return e.select(id_col, "entity_type", "value", F.least(F.lit(1.0), F.greatest(F.lit(0.1), conf)).alias("confidence"))


def _part(c: Column, pattern: str, group: int) -> Column:
    x = F.lower(F.regexp_extract(c, pattern, group))
    month = F.coalesce(*[F.when(x == m, F.lit(f"{i:02d}")) for m, i in MONTHS.items()])
    return F.coalesce(month, F.lpad(x, 2, "0"))


def parse_date(c: Column) -> Column:
    """ISO form by the first of five patterns that occurs, else the first year as its January 1st, else null.

    Parts are not range-checked, so ``2022-15-07`` can come out; ``valid_date`` checks them.
    """
    out = [F.when(c.rlike(p), F.concat(F.regexp_extract(c, p, y), F.lit("-"), _part(c, p, m), F.lit("-"), _part(c, p, d))) for p, y, m, d in DATE_PATTERNS]
    return F.coalesce(*out, F.when(c.rlike(r"\b(?:19|20)\d{2}\b"), F.concat(F.regexp_extract(c, r"\b(?:19|20)\d{2}\b", 0), F.lit("-01-01"))))


def valid_date(c: Column) -> Column:
    return F.try_to_date(parse_date(c), "yyyy-MM-dd")


def academic_year(c: Column) -> dict[str, Column]:
    a, b = F.regexp_extract(c, ACADEMIC_YEAR, 1), F.regexp_extract(c, ACADEMIC_YEAR, 2)
    return {"start_year": a.try_cast("int"), "end_year": F.when(F.length(b) == 2, F.concat(F.substring(a, 1, 2), b)).otherwise(b).try_cast("int")}


def temporal_summary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(DATE_DMY), F.lit(0))).alias("raw")).select(id_col, parse_date(F.col("raw")).alias("iso"))
    year = lambda x: F.substring(x, 1, 4).cast("int")
    return d.groupBy(id_col).agg(F.count("*").alias("n_dates"), F.min("iso").alias("first_date"), F.max("iso").alias("last_date")).withColumn("year_span", year(F.col("last_date")) - year(F.col("first_date")))


def any_match(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])
