"""Filters, relevance and graph lookups of the specialised agents, and upkeep of a table of topics.

A topic table has topic, name, keywords, schemes, metrics, districts, patterns, related (arrays of strings; patterns are
regular expressions). It is a reference table: ``topic_scores`` broadcasts it only up to ``MOST_TOPICS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import retrieval as R

AMENDING = r"(?i)amend|insert|substitute|omit"
MEANING, STEPS = ("means", "shall", "defined", "interpretation"), ("procedure", "steps", "process", "method")
MOST_TOPICS = 10_000


def legal_filter(df: DataFrame, text_col: str, doc_col: str, reference: str | None = None, document_type: str | None = None, has_amendments: bool = False) -> DataFrame:
    """Rows whose text names the reference, whose document id names the type, and that speak of amendments."""
    if reference is not None:
        df = df.where(F.lower(text_col).contains(reference.lower()))
    if document_type is not None:
        df = df.where(F.lower(doc_col).contains(document_type.lower()))
    return df.where(F.col(text_col).rlike(AMENDING)) if has_amendments else df


def order_filter(df: DataFrame, text_col: str, doc_col: str, number: str | None = None, scheme: str | None = None, order_type: str | None = None, year: int | None = None) -> DataFrame:
    """Rows that name an order's number, a scheme, a type (in the document id) and a year."""
    both = F.concat(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(doc_col), F.lit("")))
    if number is not None:
        df = df.where(F.lower(both).contains(number.lower()))
    if scheme is not None:
        df = df.where(F.lower(text_col).contains(scheme.lower()))
    if order_type is not None:
        df = df.where(F.lower(doc_col).contains(order_type.lower()))
    return df.where(both.contains(str(year))) if year is not None else df


def rerank(df: DataFrame, group: str, id_col: str, text_col: str, score: Column, boost: Column | None = None, k: int = 10, diversity: float = 0.3, candidates: int = 50) -> DataFrame:
    """The k best of each group after a boost, made diverse; each group brings at most ``candidates`` rows to the choice.

    Columns group, id, pick, mmr. Scores of a cross-encoder come as ``score``.
    """
    scored = df.withColumn("_score", score * boost if boost is not None else score)
    top = R.top_per_group(scored, group, candidates, "_score", id_col)
    if diversity > 0:
        return R.diversify(top, group, id_col, text_col, "_score", k, 1 - diversity)
    return top.where(F.col("rank") <= k).select(group, F.col(id_col).cast("long").alias(id_col), F.col("rank").alias("pick"), F.round("_score", 6).alias("mmr"))


def semantic_relevance(text: Column, intent: Column, entities: list[str], terms: list[str]) -> Column:
    """0.3 for the words of the intent, 0.2 for each entity and 0.1 for each expanded term; at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0
    own = F.when((intent == "legal_interpretation") & some(MEANING), 0.3).when((intent == "procedural_guidance") & some(STEPS), 0.3).otherwise(0.0)
    hits = sum((F.when(low.contains(x.lower()), w).otherwise(0.0) for names, w in ((entities, 0.2), (terms, 0.1)) for x in names), F.lit(0.0))
    return F.least(own + hits, F.lit(1.0))


def relationship_relevance(text: Column, related: dict[str, tuple[tuple[str, float], ...]]) -> Column:
    """0.2 for each entity that the text names and a tenth of the confidence of each related one; at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = sum((F.when(low.contains(e.lower()), 0.2).otherwise(0.0) for e in related), F.lit(0.0))
    others = sum((F.when(low.contains(v.lower()), 0.1 * c).otherwise(0.0) for rel in related.values() for v, c in rel), F.lit(0.0))
    return F.least(own + others, F.lit(1.0))


def retrieval_confidence(df: DataFrame, group: str, score_col: str, semantic_col: str, relationship_col: str, id_col: str) -> DataFrame:
    """(group, confidence): 0.4 of the best score, 0.3 and 0.2 of the mean relevances, 0.1 of the number of rows up to ten."""
    best = F.max_by(score_col, F.struct(F.col(score_col), -F.col(id_col)))
    c = df.groupBy(group).agg((best * 0.4 + F.avg(semantic_col) * 0.3 + F.avg(relationship_col) * 0.2 + F.least(F.count("*") / 10, F.lit(1.0)) * 0.1).alias("confidence"))
    return c.withColumn("confidence", F.least("confidence", F.lit(1.0)))


def implementing_documents(edges: DataFrame, entities: DataFrame, scheme: Column) -> DataFrame:
    """What the scheme's edges of type ``implements`` lead to: scheme id, entity_id, value."""
    own = entities.where((F.col("entity_type") == "scheme") & (F.lower("value") == F.lower(scheme))).select(F.col("entity_id").alias("source"))
    to = edges.where("relation_type = 'implements'").join(own, "source").select("source", F.col("target").alias("entity_id")).distinct()
    return to.join(entities.select("entity_id", "value"), "entity_id").select("source", "entity_id", "value")


def order_warnings(asked: DataFrame, ends: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """For queries that name a replaced order: (id, order, current, warning, n_chain); ``ends`` is that of graph.chain_ends."""
    j = asked.join(ends, asked[order_col] == ends["start"])
    return j.select(id_col, order_col, "current", F.concat(F.col(order_col).cast("string"), F.lit(" was superseded by "), F.col("current").cast("string")).alias("warning"), (F.col("length") + 1).alias("n_chain"))


def scheme_expansions(asked: DataFrame, edges: DataFrame, entities: DataFrame, id_col: str, scheme_col: str) -> DataFrame:
    """(id, scheme, expansion): the orders that implement a scheme which the query names."""
    s = entities.where("entity_type = 'scheme'").select(F.col("entity_id").alias("source"), F.lower("value").alias("_v"))
    e = edges.where("relation_type = 'implements'").select("source", "target").distinct().join(entities.select(F.col("entity_id").alias("target"), F.col("value").alias("expansion")), "target")
    return asked.withColumn("_v", F.lower(scheme_col)).join(s, "_v").join(e, "source").select(id_col, scheme_col, "expansion")


# Topics


def topic_scores(df: DataFrame, id_col: str, text_col: str, topics: DataFrame, weights=(1.0, 1.2, 1.3)) -> DataFrame:
    """(id, topic, keyword, entity, pattern, score) of every text and topic that score above nought.

    The topic table becomes one row, so a text meets it inside its own row; above MOST_TOPICS topics this refuses.
    """
    n = topics.limit(MOST_TOPICS + 1).count()
    if n > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    t = topics.select("topic", *[F.transform(c, lambda x: F.lower(x)).alias(c) for c in ("keywords", "schemes", "metrics", "districts")], "patterns")
    low, text = F.col("_low"), F.col("_text")

    def keyword(k):
        parts = F.filter(F.split(k, r"\s+"), lambda w: w != "")
        return F.when(F.contains(low, k), 2.0).otherwise(F.size(F.filter(parts, lambda w: F.contains(low, w))) / F.greatest(F.size(parts), F.lit(1)))

    add = lambda column, f: F.aggregate(column, F.lit(0.0), lambda a, x: a + f(x))
    named = lambda w: lambda x: F.when(F.contains(low, x), float(w)).otherwise(0.0)
    one = t.agg(F.collect_list(F.struct(*t.columns)).alias("_topics"))  # at most MOST_TOPICS
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low")).crossJoin(F.broadcast(one))  # with one row

    def scored(x):
        entity = add(x["schemes"], named(3)) + add(x["metrics"], named(2)) + add(x["districts"], named(1.5))
        return F.struct(x["topic"].alias("topic"), add(x["keywords"], keyword).alias("keyword"), entity.alias("entity"), add(x["patterns"], lambda p: F.regexp_count(text, p) * 1.5).alias("pattern"))

    s = rows.select(id_col, F.explode(F.transform("_topics", scored)).alias("s")).select(id_col, "s.*")
    a, b, c = weights
    return s.withColumn("score", F.round(F.col("keyword") * a + F.col("entity") * b + F.col("pattern") * c, 6)).where("score > 0")


def best_topics(scores: DataFrame, id_col: str, least: float = 1.5, high: float = 3.0, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "topic"))
    return scores.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k).withColumn("level", F.when(F.col("score") >= high, "high").otherwise("medium")).select(id_col, "topic", "score", "level", "rank")


def legal_reference_score(topic: Column, kind: Column, number: Column, act: Column) -> Column:
    """Of one reference: 3 for section 12 of the RTE act under its own topic, 2 under other RTE topics, 2.5 for section 21 under school management committees, and 1 for the act itself."""
    rte = F.contains(F.lower(F.coalesce(act, F.lit(""))), F.lit("rte"))
    section = (kind == "section") & number.isNotNull()
    own = F.when(topic == "rte_section_12_1_c", F.when(section & (number == "12") & rte, 3.0)).when(topic.startswith("rte_"), F.when(rte, 2.0)).when(topic == "school_management_committees", F.when(section & (number == "21"), 2.5))
    return F.coalesce(own, F.lit(0.0)) + F.when(rte, 1.0).otherwise(0.0)


def related_topics(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """(topic, related): one row per related topic of the wanted ones."""
    return topics.join(wanted.select("topic").distinct(), "topic", "left_semi").select("topic", F.explode("related").alias("related"))


def topics_by_keyword(topics: DataFrame, keyword: str) -> DataFrame:
    """Topics with the word inside a keyword or their name."""
    w = F.lit(keyword.lower())
    return topics.where(F.exists("keywords", lambda k: F.contains(F.lower(k), w)) | F.contains(F.lower("name"), w)).select("topic")


def topics_by_entity(topics: DataFrame, value: str, kind: str) -> DataFrame:
    """Topics that list the entity under its kind (scheme, metric, district), or else as a keyword."""
    listed = lambda c: F.exists(c, lambda k: F.lower(k) == value.lower())
    own = {"scheme": "schemes", "metric": "metrics", "district": "districts"}.get(kind)
    return topics.where((listed(own) | listed("keywords")) if own else listed("keywords")).select("topic")


def update_documents(documents: DataFrame, matches: DataFrame, categories: dict[str, str], default: str = "external_doc_ids") -> DataFrame:
    """(topic, category, doc_id): known documents of the topics and those newly matched (topic, doc_id, doc_type), each once."""
    m = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    new = matches.select("topic", F.coalesce(F.element_at(m, F.lower("doc_type")), F.lit(default)).alias("category"), "doc_id")
    return documents.select("topic", "category", "doc_id").unionByName(new).distinct()
