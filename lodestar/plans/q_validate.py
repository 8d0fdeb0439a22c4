"""Queries of the validator: names of the dictionaries with up to three errors, in queries made from the stored documents.

A document gives one entity, five of them a query. The SQL compares every name with every entry (forms of 62 letters at most).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..operators import validate as A
from ..operators.graph import kept
from ..sources.scratch import shared_folder
from .corpus import table
from .duck import lit

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


NAMES = [("district", n) for n in sorted({*D.DISTRICTS, *D.GAZETTEER["districts"]})] + [("scheme", n) for n in sorted({*D.SCHEMES, *D.GAZETTEER["schemes"]})] + [("metric", n) for n in D.GAZETTEER["metrics"]]
_OTHERS = ["Atlantis", "Gondolin", "Brigadoon", "Free Dragon Scheme"]
_KINDS = {k: [n for kind, n in NAMES if kind == k] for k in ("district", "scheme", "metric")}
# What Spark and ANSI SQL share: which name, how many errors and where, from the id and the length of the document.
_CHOICES = [(k, i, n, len(v) + len(_OTHERS)) for k, v in _KINDS.items() for i, n in enumerate(v + _OTHERS)]
_H = "(doc_id * 7919 + len * 31)"
_KIND = "CASE WHEN doc_id % 11 = 3 THEN 'date' WHEN doc_id % 11 IN (4, 9) THEN 'scheme' WHEN doc_id % 11 = 7 THEN 'metric' ELSE 'district' END"
_YEAR = "CASE WHEN h % 9 = 0 THEN 'last year' ELSE CAST(1995 + h % 41 AS STRING) || '-' || CAST((1996 + h % 41) % 100 AS STRING) END"
_AT = "CAST(1 + floor(h / {}) % length({}) AS INT)"
_LOST = f"substr(name, 1, {_AT.format(3, 'name')} - 1) || substr(name, {_AT.format(3, 'name')} + 1)"
_SWAPPED = f"substr(lost, 1, {_AT.format(11, 'lost')} - 1) || chr(CAST(97 + h % 26 AS INT)) || substr(lost, {_AT.format(11, 'lost')} + 1)"
_ADDED = f"substr(swapped, 1, {_AT.format(17, 'swapped')}) || chr(CAST(97 + floor(h / 5) % 26 AS INT)) || substr(swapped, {_AT.format(17, 'swapped')} + 1)"
_BASE = f"SELECT doc_id, {_H} AS h, {_KIND} AS kind FROM (SELECT doc_id, length(coalesce(text, '')) AS len FROM documents) l"
_PICKED = f"SELECT b.doc_id, b.h, b.kind, coalesce(c.name, {_YEAR}) AS name FROM ({_BASE}) b LEFT JOIN choices c ON b.kind = c.kind AND b.h % c.n = c.i"
_ENTITIES = f"""
SELECT CAST(floor(doc_id / 5) AS BIGINT) AS qid, doc_id, kind, name,
       CASE WHEN kind = 'date' OR h % 4 = 0 THEN name WHEN h % 4 = 1 THEN lost WHEN h % 4 = 2 THEN swapped ELSE {_ADDED} END AS value
FROM (SELECT *, {_SWAPPED} AS swapped FROM (SELECT *, {_LOST} AS lost FROM ({_PICKED}) p) q) r
"""


def _entities(spark, sf):
    choices = spark.createDataFrame(_CHOICES, "kind string, i int, name string, n int")
    sql = _ENTITIES.replace("FROM documents", "FROM {documents}").replace("JOIN choices", "JOIN {choices}")
    e = spark.sql(sql, documents=table(spark, sf, "documents").select("doc_id", "text"), choices=F.broadcast(choices))  # an entry per name of the dictionaries
    return kept(e, shared_folder(spark, "entities"), "0")


def _queries(entities):
    """A query names the right form of every other entity."""
    named = F.array_sort(F.collect_list(F.when(F.col("doc_id") % 2 == 0, F.col("name"))))
    return entities.groupBy("qid").agg(F.concat(F.lit("Compare "), F.array_join(named, " and ")).alias("text"))


def _dictionary(spark):
    return spark.createDataFrame(NAMES, "kind string, name string")


def _form(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'))"


def _mask(a: str, b: str) -> str:
    bits = f"list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, i::INTEGER + 1, 1) = substr({b}, k::INTEGER, 1) THEN 1::BIGINT << i::INTEGER ELSE 0::BIGINT END))"
    return f"list_transform(range(1, length({b}) + 1), lambda k: {bits}::BIGINT)"


def _ratio(a: str, b: str) -> str:
    full = "4611686018427387903::BIGINT"
    v = f"list_reduce({_mask(a, b)}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE floor(200.0 * (62 - bit_count({v})) / (length({a}) + length({b})) + 0.5)::INTEGER END"


_E = f"""
choices AS (SELECT * FROM (VALUES {", ".join(f"({lit(k)}, {i}, {lit(n)}, {m})" for k, i, n, m in _CHOICES)}) v(kind, i, name, n)),
e AS MATERIALIZED ({_ENTITIES.replace("AS STRING", "AS VARCHAR")}),
dict AS (SELECT * FROM (VALUES {", ".join(f"({lit(k)}, {lit(n)})" for k, n in NAMES)}) v(kind, name)),
unknown AS (SELECT DISTINCT kind, value FROM e WHERE kind <> 'date' AND NOT EXISTS (SELECT 1 FROM dict WHERE dict.kind = e.kind AND dict.name = e.value)),
pairs AS MATERIALIZED (SELECT u.kind, u.value, d.name AS match, {_form("u.value")} AS f, {_form("d.name")} AS g FROM unknown u JOIN dict d USING (kind)),
sets AS MATERIALIZED (SELECT *, list_filter(string_split_regex(f, ' +'), lambda t: t <> '') AS x, list_filter(string_split_regex(g, ' +'), lambda t: t <> '') AS y FROM pairs),
parts AS MATERIALIZED (SELECT kind, value, match, f, g, array_to_string(list_sort(list_distinct(list_intersect(x, y))), ' ') AS s,
      array_to_string(list_sort(list_distinct(list_filter(x, lambda t: NOT list_contains(y, t)))), ' ') AS ox, array_to_string(list_sort(list_distinct(list_filter(y, lambda t: NOT list_contains(x, t)))), ' ') AS oy FROM sets),
joined AS MATERIALIZED (SELECT kind, value, match, f, g, s, trim(s || ' ' || ox) AS o, trim(s || ' ' || oy) AS t FROM parts),
scored AS MATERIALIZED (SELECT kind, value, match, CASE WHEN kind = 'district' THEN {_ratio("f", "g")} ELSE greatest({_ratio("s", "o")}, {_ratio("s", "t")}, {_ratio("o", "t")}) END AS score FROM joined),
best AS (SELECT * FROM scored WHERE score >= {A.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY score DESC, match) = 1),
q AS (SELECT qid, lower('Compare ' || coalesce(string_agg(CASE WHEN doc_id % 2 = 0 THEN name END, ' and ' ORDER BY name), '')) AS low FROM e GROUP BY 1),
yr AS (SELECT qid, kind, value, TRY_CAST(regexp_extract(value, '^\\s*([+-]?\\d+)\\s*(?:-|$)', 1) AS INTEGER) AS year FROM e WHERE kind = 'date'),
issues AS (
 SELECT qid, e.kind, e.value, CASE WHEN match IS NOT NULL THEN 'typo_corrected' ELSE 'invalid_entity' END AS issue,
        CASE WHEN match IS NOT NULL THEN 'info' WHEN e.kind = 'district' THEN 'error' ELSE 'warning' END AS severity, match AS suggestion, score
 FROM e JOIN unknown u ON e.kind = u.kind AND e.value = u.value LEFT JOIN best b ON b.kind = e.kind AND b.value = e.value WHERE e.kind <> 'metric' OR match IS NOT NULL
 UNION ALL SELECT qid, kind, value, CASE WHEN year IS NULL THEN 'invalid_format' ELSE 'out_of_range' END, CASE WHEN year IS NULL THEN 'error' ELSE 'warning' END, CASE WHEN year IS NOT NULL THEN '2010-2025' END, NULL FROM yr WHERE year IS NULL OR year NOT BETWEEN 2010 AND 2025
 UNION ALL SELECT qid, kind, v, 'possible_hallucination', 'warning', NULL, NULL FROM (SELECT qid, e.kind, coalesce(match, e.value) AS v FROM e LEFT JOIN best b ON b.kind = e.kind AND b.value = e.value WHERE e.kind = 'district') JOIN q USING (qid) WHERE NOT contains(low, lower(v))
 UNION ALL SELECT qid, 'district', count(*)::VARCHAR, 'excessive_entities', 'warning', NULL, NULL FROM e WHERE kind = 'district' GROUP BY 1 HAVING count(*) > {A.MOST_DISTRICTS})"""


@query("u16b_closest_names", f"WITH {_E} SELECT kind, value AS name, match, score FROM best")
def _(spark, sf):
    e = _entities(spark, sf).where("kind <> 'date'").select("kind", F.col("value").alias("name"))
    d = _dictionary(spark)
    return A.closest(e.join(d, ["kind", "name"], "left_anti"), d)


@query("n07b_validation_issues", f"WITH {_E} SELECT qid, kind, value, issue, severity, suggestion, score FROM issues")
def _(spark, sf):
    e = _entities(spark, sf)
    return A.validate(e, _queries(e), _dictionary(spark))


@query("n07c_query_validity", f"WITH {_E} SELECT qid, count(*) FILTER (severity = 'error') = 0 AS is_valid, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (issue = 'typo_corrected') AS n_corrections FROM q LEFT JOIN issues USING (qid) GROUP BY 1")
def _(spark, sf):
    e = _entities(spark, sf)
    q = _queries(e)
    return A.validity(A.validate(e, q, _dictionary(spark)), q)
