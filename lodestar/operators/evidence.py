"""Matches with their place and context, and what is built on them: entities, relations, ranges, periods, relationships.

All of it is built-in functions inside one row of a text; only the counts that are asked for shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import extract as E
from ..functions.text import may_match

# Fixed values: (kind, confidence, pattern, group of the value).
ENTITIES = (
    ("legal_ref", 0.9, r"(?i)section\s+(\d+(?:\(\d+\))?(?:\([a-z]\))?)\s+of\s+(?:the\s+)?([A-Z][^.]{10,50}(?:Act|Rules))", 0),
    ("legal_ref", 0.9, r"(?i)sections?\s+(\d+(?:\s*(?:and|,|to)\s*\d+)*)\s+of\s+(?:the\s+)?([A-Z][^.]{10,50}(?:Act|Rules))", 0),
    ("legal_ref", 0.9, r"(?i)article\s+(\d+[A-Z]?)\s+of\s+(?:the\s+)?([A-Z][^.]{10,50}(?:Constitution|Charter))", 0),
    ("legal_ref", 0.9, r"(?i)rule\s+(\d+(?:\(\d+\))?)\s+of\s+(?:the\s+)?([A-Z][^.]{10,50}Rules)", 0),
    ("legal_ref", 0.9, r"(?i)(?:as per|in accordance with|pursuant to|under)\s+(section\s+\d+(?:\(\d+\))?(?:\([a-z]\))?)", 0),
    ("legal_ref", 0.9, r"(?i)(?:vide|as per|under)\s+([A-Z][^.]{5,30}(?:Act|Rules))", 0),
    ("go_ref", 0.9, r"(?i)G\.?O\.?\s*M\.?S\.?\s*No\.?\s*(\d+)\s*(?:dated?\s*|dt\.?\s*|of\s*)?(\d{1,2}[.-]\d{1,2}[.-]\d{2,4})?", 0),
    ("go_ref", 0.9, r"(?i)GO\s+(?:MS\s+)?No\.?\s*(\d+)(?:/(\d{4}))?(?:\s*dated?\s*(\d{1,2}[.-]\d{1,2}[.-]\d{2,4}))?", 0),
    ("go_ref", 0.9, r"(?i)Government\s+Order\s+(?:MS\s+)?No\.?\s*(\d+)", 0),
    ("go_ref", 0.9, r"(?i)vide\s+GO\s+(?:No\.?\s*)?(\d+)", 0),
    ("go_ref", 0.9, r"(?i)Proc\.?\s*(?:Rc\.?\s*)?No\.?\s*(\d+(?:[/-]\w+)*)", 0),
    ("go_ref", 0.9, r"(?i)Proceedings\s+(?:Rc\.?\s*)?No\.?\s*(\d+(?:[/-]\w+)*)", 0),
)
RELATIONS = (
    ("supersedes", 0.9, r"(?i)in\s+supersession\s+of\s+(?:GO\s+(?:MS\s+)?No\.?\s*(\d+)(?:/(\d{4}))?|earlier\s+(?:order|GO))", 0),
    ("supersedes", 0.9, r"(?i)this\s+order\s+supersedes?\s+(?:GO\s+(?:MS\s+)?No\.?\s*(\d+)|earlier\s+(?:order|GO))", 0),
    ("supersedes", 0.9, r"(?i)in\s+(?:partial\s+)?modification\s+of\s+(?:GO\s+(?:MS\s+)?No\.?\s*(\d+))", 0),
    ("supersedes", 0.9, r"(?i)supersedes?\s+(?:the\s+)?(?:earlier\s+)?(?:order|GO)", 0),
    ("implements", 0.85, r"(?i)in\s+pursuance\s+of\s+(section\s+\d+(?:\(\d+\))?)", 1),
    ("implements", 0.85, r"(?i)for\s+implementation\s+of\s+(?:the\s+)?([A-Z][^.]{10,50}(?:Act|Rules|Scheme))", 1),
    ("implements", 0.85, r"(?i)in\s+accordance\s+with\s+(?:the\s+provisions\s+of\s+)?([A-Z][^.]{10,50}(?:Act|Rules))", 1),
    ("implements", 0.85, r"(?i)under\s+(?:the\s+provisions\s+of\s+)?([A-Z][^.]{10,50}(?:Act|Rules))", 1),
    ("cites", 0.8, r"(?i)as\s+(?:mentioned|stated|provided)\s+in\s+([A-Z][^.]{10,50}(?:Act|Rules|Order))", 1),
    ("cites", 0.8, r"(?i)as\s+per\s+(?:the\s+)?([A-Z][^.]{10,50}(?:Act|Rules|Order|Guidelines))", 1),
    ("cites", 0.8, r"(?i)reference\s+(?:is\s+)?(?:made\s+)?to\s+([A-Z][^.]{10,50}(?:Act|Rules))", 1),
)
#: Relationships of the graph: (type, pattern).
_SECTION = r"(?:Section\s+)?(\d+(?:\([a-z]\))?)"
_ORDER = r"G\.?O\.?\s*(?:Ms\.?|Rt\.?)?\s*No\.?\s*(\d+)"
RELATIONSHIPS = (
    ("supersedes", rf"(?i)supersedes?\s+{_ORDER}"), ("supersedes", rf"(?i)in\s+supersession\s+of\s+.*?{_ORDER}"), ("supersedes", rf"(?i)replaces?\s+.*?{_ORDER}"), ("supersedes", rf"(?i)cancels?\s+.*?{_ORDER}"),
    ("implements", rf"(?i)(?:in\s+)?(?:pursuant|pursuance)\s+(?:to|of)\s+{_SECTION}"), ("implements", rf"(?i)under\s+{_SECTION}"), ("implements", rf"(?i)as\s+per\s+{_SECTION}"),
    ("references", rf"(?i)(?:refer|see|vide)\s+{_SECTION}"), ("references", rf"(?i)as\s+defined\s+in\s+{_SECTION}"), ("references", rf"(?i)subject\s+to\s+{_SECTION}"), ("references", rf"(?i)read\s+with\s+{_SECTION}"),
    ("references", rf"(?i)conjunction\s+with\s+{_SECTION}"),
)
CROSS = (
    rf"(?i){_SECTION}\s+read\s+with\s+{_SECTION}", rf"(?i){_SECTION}\s+and\s+{_SECTION}", rf"(?i){_SECTION}\s+(?:along\s+with|together\s+with)\s+{_SECTION}",
)
OWN_SECTION = r"(?i)(?:Section|Article|Rule|Chapter)\s+(\d+(?:\([a-z]\))?)"
ORDERED = r"hereby|it is ordered|government orders"
RANGES = (
    r"(?i)\b(?:from|between)\s+([^.]+?)\s+(?:to|and)\s+([^.,;]+?)(?:[.,;]|$)", r"(?i)\bduring (?:the )?period\s+([^.]+?)\s+to\s+([^.,;]+?)(?:[.,;]|$)", r"(?i)\bin the years?\s+(\d{4})-(\d{4})\b",
)
PERIODS = (
    r"(?i)\b(?:Q[1-4]|(?:first|second|third|fourth)\s+quarter)\s+(?:of\s+)?(\d{4})\b", r"(?i)\b(?:(?:first|second)\s+semester|sem\s*[12])\s+(?:of\s+)?(\d{4})\b", r"(?i)\b(?:first|second)\s+half\s+(?:of\s+)?(\d{4})\b",
)


def context(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """The characters around a place, without white space at the ends; places count from 0."""
    lo = F.greatest(start - window, F.lit(0))
    return F.regexp_replace(F.substr(text, lo + 1, end + window - lo), r"^\s+|\s+$", "")


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match in order, as structs of whole, value (the group), start and end."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    shape = "array<struct<whole:string,value:string,start:int,end:int>>"

    def add(acc, x):
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["whole"])
        row = F.struct(x["whole"].alias("whole"), x["value"].alias("value"), at.alias("start"), end.alias("end"))
        # The last part has no match after it.
        return F.when(x["whole"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], row).alias("out")))

    none = F.array().cast(shape)
    # One search settles the texts without a match, which are most.
    return F.when(may_match(text, pattern) & text.rlike(pattern), F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])).otherwise(none)


def found(df: DataFrame, id_col: str, text_col: str, rules, window: int = 50) -> DataFrame:
    """(id, kind, value, confidence, start, end, context) of every match of rules (kind, confidence, pattern, group)."""
    t = F.coalesce(F.col(text_col), F.lit(""))

    def named(kind: str, confidence: float):
        return lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x["value"]).alias("value"), F.lit(confidence).alias("confidence"), x["start"].alias("start"), x["end"].alias("end"))

    each = [F.transform(spans(t, p, g), named(k, c)) for k, c, p, g in rules]
    rows = df.select(F.col(id_col), t.alias("_t"), F.explode(F.concat(*each)).alias("m"))
    return rows.select(id_col, "m.*", context(F.col("_t"), F.col("m.start"), F.col("m.end"), window).alias("context"))


def entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """References with place and context, and the dictionary names: schemes 0.95, metrics 0.9, districts 0.8."""
    names = (("scheme", 0.95, D.any_of(D.SCHEMES), 0), *(("metric", 0.9, p, 0) for p in E.SIMPLE["metrics"]), ("district", 0.8, D.any_of(D.DISTRICTS), 0))
    return found(df, id_col, text_col, (*ENTITIES, *names))


def relations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Supersessions 0.9, implementations 0.85 and citations 0.8 with their evidence."""
    return found(df, id_col, text_col, RELATIONS)


def relations_in_context(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The relations of the first extractor with 50 characters around them."""
    return found(df, id_col, text_col, E.RELATIONS)


def analysis(df: DataFrame, id_col: str, text_col: str, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per text: n_entities, n_relations, topics (those with two keyword or entity hits or more)."""
    e = entities(df, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("n_entities"), F.collect_set(F.lower("value")).alias("values"))
    r = relations(df, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("n_relations"))
    j = df.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low")).join(e, id_col, "left").join(r, id_col, "left")
    none = F.array().cast("array<string>")

    def hits(words):
        return sum((F.when(F.contains("_low", F.lit(w)), 1).otherwise(0) + F.when(F.array_contains(F.coalesce("values", none), w), 1).otherwise(0) for w in words), F.lit(0))

    matched = F.filter(F.array(*[F.when(hits(words) >= 2, F.lit(t)) for t, words in topics.items()]), lambda x: x.isNotNull())
    return j.select(id_col, F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"), matched.alias("topics"))


def extraction_statistics(analysed: DataFrame) -> DataFrame:
    """One row: texts, entities, relations, texts with a topic, means."""
    return analysed.agg(
        F.count("*").alias("n_chunks"), F.sum("n_entities").alias("n_entities"), F.sum("n_relations").alias("n_relations"), F.count_if(F.size("topics") > 0).alias("n_with_topic"),
        F.avg("n_entities").alias("mean_entities"), F.avg("n_relations").alias("mean_relations"),
    )


def date_ranges(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, start_date, end_date, start, context, confidence) where both ends are dates."""
    t = F.coalesce(F.col(text_col), F.lit(""))

    def ends(p: str):
        return lambda x: F.struct(x["whole"].alias("raw"), F.regexp_extract(x["whole"], p, 1).alias("a"), F.regexp_extract(x["whole"], p, 2).alias("b"), x["start"].alias("start"), x["end"].alias("end"))

    each = [F.transform(spans(t, p), ends(p)) for p in RANGES]
    r = df.select(id_col, t.alias("_t"), F.explode(F.concat(*each)).alias("r")).select(id_col, "_t", "r.*")
    r = r.select(id_col, "raw", E.parse_date(F.trim("a")).alias("start_date"), E.parse_date(F.trim("b")).alias("end_date"), "start", context(F.col("_t"), F.col("start"), F.col("start")).alias("context"), F.lit(0.85).alias("confidence"))
    return r.where("start_date is not null and end_date is not null")


def periods(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, period_type, raw, year, start, confidence) of quarters, semesters and halves."""
    rows = found(df, id_col, text_col, [("period", 0.8, p, 0) for p in PERIODS])
    low = F.lower("value")
    kind = F.when(low.contains("q"), "quarter").when(low.contains("sem"), "semester").when(low.contains("half"), "half_year").otherwise("period")
    return rows.select(id_col, kind.alias("period_type"), F.col("value").alias("raw"), F.regexp_extract("value", r"(\d{4})$", 1).cast("int").alias("year"), "start", "confidence")


def temporal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text: the numbers of dates, academic years, ranges and periods; zeros for an empty one."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(id_col, F.size(F.regexp_extract_all(t, F.lit(E.DATE_DMY), F.lit(0))).alias("n_dates"), F.size(F.regexp_extract_all(t, F.lit(E.ACADEMIC_YEAR), F.lit(0))).alias("n_academic_years"))
    for name, rows in (("n_ranges", date_ranges(df, id_col, text_col)), ("n_periods", periods(df, id_col, text_col))):
        base = base.join(rows.groupBy(id_col).agg(F.count("*").alias(name)), id_col, "left").na.fill(0, [name])
    return base


def relationships(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, source, target, relation_type, confidence, evidence) between orders and between sections.

    A supersession goes from the order named in the first 500 characters, an implementation or
    reference from the last section before it. 0.7, a tenth more for a match over ten characters, a fifth for the language of
    orders within 100 characters and a fifth for a supersession that says so; at least 0.2, at most 1.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    own_order = F.regexp_extract(F.substring(t, 1, 500), rf"(?i){_ORDER}", 1)

    def rows(kind, pattern):
        def one(x):
            near = F.lower(context(t, x["start"], x["end"], 100))
            conf = F.lit(0.7) + F.when(F.length(x["whole"]) > 10, 0.1).otherwise(0.0) + F.when(near.rlike(ORDERED), 0.2).otherwise(0.0)
            if kind == "supersedes":
                conf += F.when(near.contains("supersession"), 0.2).otherwise(0.0)
            before = F.get(F.reverse(F.regexp_extract_all(F.substr(t, F.lit(1), x["start"]), F.lit(OWN_SECTION), F.lit(1))), F.lit(0))
            source = F.when(own_order != "", F.concat(F.lit("government_order_"), own_order)) if kind == "supersedes" else F.concat(F.lit("legal_section_"), before)
            target = F.concat(F.lit("government_order_" if kind == "supersedes" else "legal_section_"), x["value"])
            return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("relation_type"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.2), conf)), 6).alias("confidence"), x["whole"].alias("evidence"))

        return F.transform(spans(t, pattern, 1), one)

    def crossed(pattern):
        part = lambda x, g: F.concat(F.lit("legal_section_"), F.regexp_extract(x["whole"], pattern, g))
        conf = lambda x: F.round(F.lit(0.7) + F.when(F.length(x["whole"]) > 10, 0.1).otherwise(0.0) + F.when(F.lower(context(t, x["start"], x["end"], 100)).rlike(ORDERED), 0.2).otherwise(0.0), 6)
        return F.transform(spans(t, pattern), lambda x: F.struct(part(x, 1).alias("source"), part(x, 2).alias("target"), F.lit("cross_references").alias("relation_type"), conf(x).alias("confidence"), x["whole"].alias("evidence")))

    each = [*(rows(k, p) for k, p in RELATIONSHIPS), *(crossed(p) for p in CROSS)]
    out = df.select(F.col(id_col), F.explode(F.concat(*each)).alias("r")).select(id_col, "r.*")
    return out.where("source is not null and target is not null")


def metric_pairs(text: Column, most: int = 20) -> Column:
    """Names of rates, ratios and percentages that are given a value."""
    pattern = r"([A-Za-z ]+ (?:rate|ratio|percentage)) (?:was|is|rose)"
    return F.when(~may_match(text, pattern), F.array().cast("array<string>")).otherwise(F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, most))


def all_entities(df: DataFrame, id_col: str, text_col: str, orders: bool = True) -> DataFrame:
    """(id, kind, value): every kind of the first extractor at once, distinct; ``orders`` adds government orders in their standard form."""
    t = F.coalesce(F.col(text_col), F.lit(""))

    def named(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    each = [F.transform(E.matches(t, p), named(k)) for k, p in E.SIMPLE.items()] + [F.transform(E.order_references(t), named("go_refs"))] * orders
    return df.select(id_col, F.explode(reduce(F.concat, each)).alias("e")).select(id_col, "e.*")

