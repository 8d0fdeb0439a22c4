"""Document classification and features, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import may_match

# Type -> (structure, language, title patterns), matched without case.
TYPE_PATTERNS = {
    "act": (
        (r"\bchapter\s+\d+\b", r"\bsection\s+\d+", r"\bpreamble\b", r"\benactment\b"),
        (r"\bwhereas\b", r"\bbe it enacted\b", r"\bnothing in this act\b", r"\bsubject to\b"),
        (r"\bact\b", r"\beducation act\b", r"\bright.*education\b"),
    ),
    "rule": (
        (r"\brule\s+\d+", r"\bchapter\s+\d+", r"\bform\s+[ivx]+\b"),
        (r"\bin exercise of.*powers.*conferred\b", r"\bin pursuance of\b", r"\bthese rules may be called\b", r"\bimplementing\b"),
        (r"\brules?\b", r"\beducation rules\b"),
    ),
    "government_order": (
        (r"\bg\.?o\.?\s*(?:ms\.?|ms\.?)", r"\border\b.*\bdated?\b", r"\bpresent.*orders?\b"),
        (r"\borders?\b", r"\bdirected to\b", r"\bhere?by orders?\b", r"\bwith immediate effect\b"),
        (r"\bgovernment order\b", r"\bg\.?o\b"),
    ),
    "judicial": (
        (r"\bvs?\.?\b.*\bon\s+\d+", r"\bpetitioner\b", r"\brespondent\b", r"\bjudgment\b"),
        (r"\bheld that\b", r"\bit is.*ordered\b", r"\bthe court\b", r"\bhonourable.*court\b"),
        (r"\bvs?\.\b", r"\bsupreme court\b", r"\bhigh court\b"),
    ),
    "data_report": (
        (r"\btable\s+\d+", r"\bfigure\s+\d+", r"\bappendix\b", r"\bstatistics\b"),
        (r"\bdata shows?\b", r"\bpercentage\b", r"\benrollment\b", r"\banalysis\b"),
        (r"\breport\b", r"\bdata\b", r"\bstatistics\b", r"\budise\b"),
    ),
    "budget_finance": (
        (r"\bvolume\s+[ivx]+", r"\ballocation\b", r"\bexpenditure\b", r"\bbudget\b"),
        (r"\bcrores?\b", r"\blakhs?\b", r"\bfinancial year\b", r"\bresource allocation\b"),
        (r"\bbudget\b", r"\bfinance\b", r"\bexpenditure\b"),
    ),
    "framework": (
        (r"\bguidelines?\b", r"\bframework\b", r"\bpolicy\b", r"\bprinciples?\b"),
        (r"\brecommends?\b", r"\bshould\b", r"\bpromote\b", r"\bensure\b"),
        (r"\bpolicy\b", r"\bframework\b", r"\bguidelines?\b"),
    ),
    "circular": (
        (r"\bcircular\b", r"\bto all\b", r"\bmemorandum\b"),
        (r"\binformed that\b", r"\bbrought to.*notice\b", r"\bkindly\b", r"\bfurther action\b"),
        (r"\bcircular\b", r"\bmemo\b", r"\bletter\b"),
    ),
}
WEIGHTS = (2.0, 1.5, 3.0)
FOLDER_TYPES = {
    "acts": "act", "statutory": "act", "rules": "rule", "government_orders": "government_order", "go": "government_order", "judicial": "judicial", "judiciary": "judicial",
    "data_reports": "data_report", "achievement": "data_report", "budget": "budget_finance", "financial": "budget_finance", "policy": "framework", "frameworks": "framework", "guidelines": "framework",
}
FEATURES = {
    "has_sections": r"(?i)\bsection\s+\d+",
    "has_chapters": r"(?i)\bchapter\s+\d+",
    "has_rules": r"(?i)\brule\s+\d+",
    "has_go_number": r"(?i)\bG\.?O\.?\s*(?:Ms\.?|MS\.?)",
    "has_case_citation": r"(?i)\bvs?\.?\b",
    "has_tables": r"(?i)\btable\s+\d+",
    "has_financial_terms": r"(?i)\b(?:crores?|lakhs?|budget|allocation)\b",
    "has_legal_language": r"(?i)\b(?:whereas|enacted|hereby|subject to)\b",
    "has_administrative_language": r"(?i)\b(?:orders?|directed|immediate effect)\b",
    "has_policy_language": r"(?i)\b(?:guidelines?|framework|policy|recommends?)\b",
}
#: Collections by document type, and what a type's name may contain.
COLLECTIONS = {
    "act": "legal_documents", "rule": "legal_documents", "legal": "legal_documents", "government_order": "government_orders", "go": "government_orders", "judicial": "judicial_documents", "case_law": "judicial_documents",
    "data_report": "data_reports", "report": "data_reports",
}


def with_lower(df: DataFrame, text: str, title: str) -> DataFrame:
    """Adds _full (title and text) and _head (title) in lower case, as columns of their own: some fifty rules read them."""
    head = F.lower(F.coalesce(F.col(title), F.lit("")))
    return df.withColumn("_full", F.concat_ws(" ", head, F.lower(F.coalesce(F.col(text), F.lit(""))))).withColumn("_head", head)


def type_scores(full: Column, head: Column) -> dict[str, Column]:
    """Raw score of every type, from lower-case columns: matches in title and text weigh 2 and 1.5, in the title 3."""
    return {
        kind: reduce(lambda a, b: a + b, [F.when(~may_match(src, p), 0).otherwise(F.regexp_count(src, F.lit(p))) * w for patterns, src, w in zip(groups, (full, full, head), WEIGHTS, strict=True) for p in patterns])
        for kind, groups in TYPE_PATTERNS.items()
    }


def classify(df: DataFrame, text: str = "text", title: str = "title", folders: str | None = None) -> DataFrame:
    """Adds scores (struct), predicted_type, confidence, confidence_level, method.

    The best score is divided by itself, so confidence is 1 whenever anything matched; the raw
    scores stay visible. With no match at all the folder decides, else the first type. Ties go to
    the type declared first.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = with_lower(df, text, title).withColumn("scores", F.struct(*[v.alias(k) for k, v in type_scores(F.col("_full"), F.col("_head")).items()]))
    best = F.greatest(*[F.col(f"scores.{k}") for k in TYPE_PATTERNS])
    first = F.coalesce(*[F.when(F.col(f"scores.{k}") == F.col("_best"), F.lit(k)) for k in TYPE_PATTERNS])
    out = out.withColumn("_best", best)
    folder = folder_type(F.col(folders)) if folders else F.lit(None).cast("string")
    empty = ~t.rlike(r"\S")
    by_folder = (F.col("_best") == 0) & folder.isNotNull()
    conf = F.when(empty, 0.0).when(by_folder, 0.7).when(F.col("_best") > 0, 1.0).otherwise(0.0)
    return (
        out.withColumn("predicted_type", F.when(empty, "unknown").when(by_folder, folder).otherwise(first))
        .withColumn("confidence", conf)
        .withColumn("confidence_level", F.when(conf >= 0.8, "high").when(conf >= 0.6, "medium").otherwise("low"))
        .withColumn("method", F.when(empty, "insufficient_data").when(by_folder, "folder_based").otherwise("rule_based"))
        .drop("_best", "_full", "_head")
    )


def folder_type(folders: Column) -> Column:
    """Type by an array of folder names: exact names first, then names that contain a key."""
    low = F.transform(folders, F.lower)
    m = F.create_map(*[F.lit(x) for kv in FOLDER_TYPES.items() for x in kv])
    exact = F.get(F.filter(F.transform(low, lambda f: F.element_at(m, f)), lambda x: x.isNotNull()), F.lit(0))
    part = F.get(F.filter(F.transform(low, lambda f: F.coalesce(*[F.when(f.contains(k), F.lit(v)) for k, v in FOLDER_TYPES.items()])), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(exact, part)


def structural_features(text: Column, title: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n_words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    sentences = F.filter(F.split(t, r"[.!?]+"), lambda s: s.rlike(r"\S"))
    lengths = F.aggregate(F.transform(sentences, n_words), F.lit(0), lambda a, x: a + x)
    return {k: t.rlike(p) for k, p in FEATURES.items()} | {
        "word_count": n_words(t),
        "avg_sentence_length": F.when(F.size(sentences) == 0, 0.0).otherwise(lengths / F.size(sentences)),
        "title_length": n_words(F.coalesce(title, F.lit(""))),
    }


def collection_of(doc_type: Column) -> Column:
    """The collection of a type: its own, else that of a key that it contains or that contains it, else external_sources."""
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    m = F.create_map(*[F.lit(x) for kv in COLLECTIONS.items() for x in kv])
    part = [F.when((t != "") & (t.contains(k) | F.lit(k).contains(t)), F.lit(v)) for k, v in COLLECTIONS.items()]
    return F.coalesce(F.element_at(m, t), *part, F.lit("external_sources"))


# Semantic types, the first that matches.
SEMANTIC_TYPES = (
    ("definition", r"(?i)\b(?:means|defined as|definition)\b"),
    ("procedure", r"(?i)\b(?:procedure|process|steps?|shall apply)\b"),
    ("requirement", r"(?i)\b(?:shall|must|required|mandatory)\b"),
    ("data", r"(?i)\b(?:table|figure|statistics|percentage|enrollment)\b"),
    ("reference", r"(?i)\b(?:section|article|rule|g\.o\.)"),
)


def semantic_type(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in SEMANTIC_TYPES], F.lit("general"))


def complexity(text: Column, bounds: tuple[int, ...] = (50, 200), names: tuple[str, ...] = ("simple", "moderate", "complex")) -> Column:
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    c = F.when(n < bounds[0], names[0])
    for b, name in zip(bounds[1:], names[1:], strict=False):
        c = c.when(n < b, name)
    return c.otherwise(names[len(bounds)])


def path_metadata(path: Column) -> dict[str, Column]:
    """Title, year, order number, type and folders by a path."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    folders = F.filter(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x != "")
    years = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda y: y.cast("int")), lambda y: y.between(1900, 2030))
    parent = F.coalesce(F.get(folders, F.size(folders) - 1), F.lit(""))
    return {
        "doc_id": F.regexp_replace(F.lower(F.concat_ws("_", F.when(parent != "", parent), name)), "[ -]", "_"),
        "title": F.initcap(F.regexp_replace(name, "[_-]+", " ")),
        "year": F.array_max(years),
        "go_number": F.regexp_extract(name, r"(?i)g\.?o\.?[ _-]*(?:ms|rt)?[ _.-]*(?:no)?[ _.-]*(\d+)", 1).try_cast("int"),
        "folder_type": folder_type(folders),
        "parent_folders": folders,
    }


#: vertical -> words that name it in a file name (2 points) or a folder (3).
VERTICALS = {"legal": ("act",), "orders": ("order", "g.o"), "data": ("data",)}


def vertical_of(name: Column, folder: Column) -> Column:
    """The vertical with most points, the first of the table on a tie; ``other`` without any."""
    f, d = F.lower(name), F.lower(folder)
    some = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    points = {k: F.when(some(f, w), 2).otherwise(0) + F.when(some(d, w), 3).otherwise(0) for k, w in VERTICALS.items()}
    best = F.greatest(*points.values())
    return F.when(best == 0, "other").otherwise(F.coalesce(*[F.when(p == best, F.lit(k)) for k, p in points.items()]))


def type_of_document_id(doc_id: Column) -> Column:
    """The document type that an id names; the first that fits."""
    low = F.lower(doc_id)
    return F.when(low.rlike("act|rule"), "acts").when(low.rlike("go|order"), "government_orders").when(low.rlike("case|court|judgment"), "judicial_documents").when(low.rlike("budget|data|report"), "data_reports").otherwise("external_sources")
