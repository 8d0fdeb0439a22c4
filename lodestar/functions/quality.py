"""Quality scores of documents, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds by document type.
THRESHOLDS = {
    "act": {"min_text_length": 1000, "min_entity_density": 5.0, "min_section_count": 3, "min_legal_refs": 5},
    "rule": {"min_text_length": 800, "min_entity_density": 4.0, "min_section_count": 2, "min_legal_refs": 3},
    "government_order": {"min_text_length": 500, "min_entity_density": 3.0, "min_section_count": 1, "min_go_refs": 1},
    "framework": {"min_text_length": 2000, "min_entity_density": 8.0, "min_section_count": 5, "min_keywords": 10},
    "data_report": {"min_text_length": 1000, "min_entity_density": 10.0, "min_metrics": 5},
    "case_law": {"min_text_length": 1500, "min_entity_density": 6.0, "min_legal_refs": 8},
    "unknown": {"min_text_length": 500, "min_entity_density": 2.0, "min_section_count": 1},
}
LEVELS = {"excellent": (85, 100), "good": (70, 84), "acceptable": (50, 69), "poor": (30, 49), "critical": (0, 29)}
ARTIFACTS = (r"[^\x00-\x7F]{10,}", r"\.{4,}", r"\s{5,}")
WEIGHTS = (0.25, 0.35, 0.20, 0.20)


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"[ \t\n\r\f]+"), lambda w: w != "")


def _by_type(doc_type: Column, key: str, default: float) -> Column:
    return F.coalesce(*[F.when(doc_type == k, F.lit(v.get(key, default))) for k, v in THRESHOLDS.items()], F.lit(THRESHOLDS["unknown"].get(key, default)))


def extraction_score(text: Column) -> Column:
    """100 less penalties for a short text, many line breaks, many single characters, short words; 0 without words."""
    t = F.coalesce(text, F.lit(""))
    w = _words(t)
    n, size = F.size(w), F.length(t)
    breaks = size - F.length(F.regexp_replace(t, "\n", ""))
    chars = F.length(F.regexp_replace(t, r"[ \t\n\r\f]+", ""))
    single = F.size(F.filter(w, lambda x: F.length(x) == 1))
    loss = F.when(size < 100, 30).otherwise(0) + F.when(F.try_divide(breaks, size) > 0.1, 10).otherwise(0) + F.when(F.try_divide(single, n) > 0.3, 20).otherwise(0) + F.when(F.try_divide(chars, n) < 2, 15).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), 100 - loss))


def text_score(text: Column, doc_type: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    least, n = _by_type(doc_type, "min_text_length", 500), F.size(_words(t))
    loss = F.when(F.length(t) < least, 30).when(F.length(t) < least * 1.5, 15).otherwise(0)
    loss = reduce(lambda a, p: a + F.when(t.rlike(p), 10).otherwise(0), ARTIFACTS, loss)
    return F.greatest(F.lit(0), 100 - loss - F.when((n > 0) & (F.try_divide(F.length(t), n) > 15), 15).otherwise(0))


def entity_score(counts: dict[str, Column], doc_type: Column, text_length: Column) -> dict[str, Column]:
    """density (entities per 100 words of five characters) and score; counts: kind -> number of entities."""
    total = reduce(lambda a, b: a + b, counts.values())
    kinds = reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in counts.values()])
    density = total / F.greatest(F.lit(1), F.floor(text_length / 5)) * 100
    need = _by_type(doc_type, "min_entity_density", 2.0)
    loss = F.when(density < need, F.least(F.lit(30), F.floor((need - density) / need * 30))).when(density < need * 1.5, 10).otherwise(0)
    zero = F.lit(0)
    legal, orders, metrics = counts.get("legal_refs", zero), counts.get("go_refs", zero), counts.get("metrics", zero)
    loss += F.when(doc_type.isin("act", "rule") & (legal < _by_type(doc_type, "min_legal_refs", 3)), 15).when((doc_type == "government_order") & (orders == 0), 20).when((doc_type == "data_report") & (metrics < _by_type(doc_type, "min_metrics", 5)), 20).otherwise(0)
    loss += F.when(kinds < 3, 15).otherwise(0)
    return {"density": F.round(density, 2), "score": F.when(total == 0, 0).otherwise(F.greatest(F.lit(0), 100 - loss)).cast("int")}


def relation_score(n_relations: Column, n_types: Column, doc_type: Column) -> Column:
    lenient, strict = doc_type.isin("data_report", "framework"), doc_type.isin("act", "rule", "government_order", "case_law")
    base = F.when(strict & (n_relations == 0), 50).when(strict & (n_relations < 3), 70).otherwise(100)
    return F.when(lenient, F.when(n_relations == 0, 70).otherwise(100)).otherwise(base - F.when((n_relations > 0) & (n_types < 2), 10).otherwise(0))


def metadata_score(doc_id: Column, doc_type: Column, title: Column, year: Column, source_url: Column, file_path: Column) -> Column:
    missing = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) == "", 1).otherwise(0)
    loss = 20 * (missing(doc_id) + missing(doc_type) + missing(title)) + 5 * (missing(year) + missing(source_url) + missing(file_path))
    t = F.coalesce(title, F.lit(""))
    return F.greatest(F.lit(0), 100 - loss - F.when((t != "") & (F.length(t) < 10), 10).when(F.lower(t).contains("untitled"), 15).otherwise(0))


def overall(text: Column, entity: Column, relation: Column, metadata: Column) -> Column:
    a, b, c, d = WEIGHTS
    return F.round(text * a + entity * b + relation * c + metadata * d, 1)


def level(score: Column) -> Column:
    """The bands have closed integer ends, so a score between two of them is unknown."""
    return F.coalesce(*[F.when(score.between(lo, hi), F.lit(k)) for k, (lo, hi) in LEVELS.items()], F.lit("unknown"))


def passes_gate(score: Column, least: float = 20) -> Column:
    """Whether an extraction is good enough to go on; no score is not."""
    return F.coalesce(score, F.lit(0.0)) >= least
