"""Dictionary names in documents: the dictionary is as large as the collection, every document naming an entry or an alias."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import gazetteer as Z
from .corpus import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
# The first two to four words of a document are a name; every fourth one is an alias of the document's number.
_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_TOK} AS w FROM documents),
nm AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'scheme' WHEN doc_id % 3 = 1 THEN 'metric' ELSE 'district' END AS kind, w[1:2 + doc_id % 3] AS w, doc_id FROM d WHERE len(w) >= 2 + doc_id % 3),
en AS MATERIALIZED (SELECT kind, array_to_string(w, ' ') AS key, len(w)::INTEGER AS n, CASE WHEN doc_id % 4 = 3 THEN 'name ' || doc_id ELSE array_to_string(w, ' ') END AS value, CASE WHEN doc_id % 4 = 3 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence
      FROM nm QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY CASE WHEN doc_id % 4 = 3 THEN 0.85 ELSE 0.95 END DESC, CASE WHEN doc_id % 4 = 3 THEN 'name ' || doc_id ELSE array_to_string(w, ' ') END) = 1),
g AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM d),
h AS MATERIALIZED (SELECT doc_id, kind, i - 1 AS word, en.n, value, confidence FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM g, (SELECT unnest([2, 3, 4]) AS n) WHERE i + n - 1 <= len(w)) x JOIN en USING (key)),
b AS MATERIALIZED (SELECT *, word + n AS stop, row_number() OVER (PARTITION BY doc_id, kind ORDER BY word) AS r FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, kind, word ORDER BY n DESC) = 1)),
nx AS MATERIALIZED (SELECT a.doc_id, a.kind, a.r, c.r AS next FROM b a ASOF JOIN b c ON a.doc_id = c.doc_id AND a.kind = c.kind AND c.word >= a.stop),
pick(doc_id, kind, r) AS (SELECT doc_id, kind, 1::BIGINT FROM b WHERE r = 1 UNION ALL SELECT p.doc_id, p.kind, nx.next FROM pick p JOIN nx USING (doc_id, kind, r)),
f AS (SELECT doc_id, kind, value, confidence, word, n FROM b JOIN pick USING (doc_id, kind, r))"""


def _names(docs):
    n = F.expr("2 + doc_id % 3").cast("int")
    first = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), r"^(?:[^\p{L}\p{N}_]*[\p{L}\p{N}_]+){1,4}", 0)
    w = docs.select("doc_id", words(first).alias("w")).where(F.size("w") >= n)
    kind = F.when(F.col("doc_id") % 3 == 0, "scheme").when(F.col("doc_id") % 3 == 1, "metric").otherwise("district")
    alias = F.col("doc_id") % 4 == 3
    canonical = F.when(alias, F.concat(F.lit("name "), F.col("doc_id").cast("string")))
    return w.select(kind.alias("kind"), F.array_join(F.slice("w", F.lit(1), n), " ").alias("name"), canonical.alias("canonical"), F.when(alias, 0.85).otherwise(0.95).alias("confidence"))


@query("e13b_dictionary_names", f"{_SQL} SELECT doc_id, kind, value, confidence, word, n FROM f")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return Z.match_names(d, _names(d)).select("doc_id", "kind", "value", "confidence", "word", "n")


@query("e21_named_in_sequence", f"{_SQL}, s AS (SELECT doc_id, kind, value, lead(kind) OVER w AS next_kind, lead(value) OVER w AS next_value FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY word, kind)) SELECT kind, value, next_kind, next_value, count(*) AS n FROM s WHERE next_kind <> kind GROUP BY ALL")
def _(spark, sf):
    """Which entry follows which of another kind: an edge of the graph for each neighbouring pair of entities of a text."""
    d = table(spark, sf, "documents")
    return Z.in_sequence(Z.match_names(d, _names(d)), "doc_id").groupBy("kind", "value", "next_kind", "next_value").agg(F.count("*").alias("n"))
