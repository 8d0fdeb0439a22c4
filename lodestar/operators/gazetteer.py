"""Names of a dictionary table in texts: sequences of words, found by an equi-join, the longest of those that begin first.

A name is the sequence of its words in lower case. A task hashes the words of a text once and tests every
sequence of a length that some name has against a Bloom filter of fixed size; what passes, which is little, is joined
with the names by the sequence itself, so the dictionary may grow without limit: a full filter lets more through and
changes no result. Only the filter and the lengths (at most ``MOST_WORDS`` numbers) are broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.scratch import shared_folder
from .graph import kept

#: Bits of the filter (4 MB), and words of a name at most.
FILTER_BITS, MOST_WORDS = 1 << 25, 64
#: Words whose hash a worker keeps.
KNOWN_WORDS = 500_000
CONTEXT = 50
_WORD = r"[\p{L}\p{N}_]+"


#: Rows of a batch that a task emits.
ROWS = 20_000


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _sequence(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    x = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        x = (x ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _bits(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return x % np.uint64(size), (x >> np.uint64(32)) % np.uint64(size)


def entries(names: DataFrame) -> DataFrame:
    """(kind, key, n, value, confidence) of names (kind, name, canonical, confidence): of equal sequences the surest, then the first canonical name."""
    w = names.select("kind", words(F.col("name")).alias("w"), F.coalesce("canonical", "name").alias("value"), "confidence").where(F.size("w").between(1, MOST_WORDS))
    w = w.select("kind", F.array_join("w", " ").alias("key"), F.size("w").alias("n"), "value", "confidence")
    best = F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.desc("confidence"), "value"))
    return w.withColumn("_rn", best).where("_rn = 1").drop("_rn")


def _filter(named: DataFrame) -> np.ndarray:
    """The filter as 64-bit words, put together in the cluster."""
    size = FILTER_BITS

    def run(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            if not keys:
                continue
            x = np.array([_sequence(np.array([_hash(w) for w in k.split(" ")], np.uint64), k.count(" ") + 1)[0] for k in keys], np.uint64)
            at = np.unique(np.concatenate(_bits(x, size)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    parts = named.select("key").distinct().mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[parts.column("at").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint64)


def occurrences(docs: DataFrame, named: DataFrame, id_col: str, text_col: str, context: bool = False) -> DataFrame:
    """(id, key, word, n, start, end[, context]): every sequence of words that is an entry; word and characters count from 0."""
    spark = docs.sparkSession
    lengths = sorted(r["n"] for r in named.select("n").distinct().collect())  # MOST_WORDS numbers at most
    shared = spark.sparkContext.broadcast((lengths, _filter(named)))
    d = docs.select(F.col(id_col), F.col(text_col))

    def run(batches):
        import regex

        find, known = regex.compile(_WORD).finditer, {}
        lengths, bits = shared.value
        has = lambda at: bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
        for b in batches:
            out = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or ""
                spans = [m.span() for m in find(text)]
                ws = [text[s:e].lower() for s, e in spans]
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in ws:
                    if w not in known:
                        known[w] = _hash(w)
                h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
                for n in lengths:
                    if n <= len(h):
                        one, two = _bits(_sequence(h, n), 64 * len(bits))
                        for i in np.flatnonzero(has(one) & has(two)).tolist():
                            s, e = spans[i][0], spans[i + n - 1][1]
                            out.append((key, " ".join(ws[i : i + n]), i, n, s, e, *((text[max(0, s - CONTEXT) : e + CONTEXT].strip(),) if context else ())))
                            if len(out) == ROWS:
                                yield _batch(out, schema)
                                out = []
            yield _batch(out, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = d.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("key", pa.string()), ("word", pa.int64()), ("n", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), *([("context", pa.string())] if context else [])])
    maybe = d.mapInArrow(run, f"{id_col} {kind.simpleString()}, key string, word long, n int, start long, end long" + ", context string" * context)
    return maybe.join(named.select("key").distinct(), "key", "left_semi")


def match_names(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: bool = False) -> DataFrame:
    """(id, kind, value, confidence, word, n, start, end, and with ``context`` the characters around it): of every kind, from left to right the longest name that begins first; none overlap.

    ``names`` has kind, name, canonical (null: the name itself) and confidence, an alias being a row with its canonical name.
    The names are stored once in the shared folder. Null texts have no names; a document of no entry gives no row; ids are unique.
    """
    named = kept(entries(names), shared_folder(docs.sparkSession, "names"), "0")
    hits = occurrences(docs, named, id_col, text_col, context).join(named.select("kind", "key", "value", "confidence"), "key")
    per = hits.groupBy(id_col, "kind").agg(F.sort_array(F.collect_list(F.struct("word", (-F.col("n")).alias("m"), "value", "confidence", "start", "end", *["context"] * context))).alias("h"))

    def choose(batches):
        for b in batches:
            out = []
            # Column by column: a dictionary for each hit costs more than the choice.
            flat, at = b.column(2).flatten(), 0
            word, m, *more = (flat.field(i).to_pylist() for i in range(flat.type.num_fields))
            for key, kind, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).value_lengths().to_pylist(), strict=True):
                end = -1
                for i in range(at, at + size):
                    if word[i] >= end:
                        end = word[i] - m[i]
                        value, confidence, *place = (c[i] for c in more)
                        out.append((key, kind, value, confidence, word[i], -m[i], *place))
                        if len(out) == ROWS:
                            yield _batch(out, schema)
                            out = []
                at += size
            yield _batch(out, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("kind", pa.string()), ("value", pa.string()), ("confidence", pa.float64()), ("word", pa.int64()), ("n", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), *([("context", pa.string())] if context else [])])
    return per.mapInArrow(choose, f"{id_col} {kind.simpleString()}, kind string, value string, confidence double, word long, n int, start long, end long" + ", context string" * context)


def in_sequence(found: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, value, next_kind, next_value): each name of a text and the next one, where that is of another kind."""
    w = Window.partitionBy(id_col).orderBy("word", "kind")
    s = found.select(id_col, "kind", "value", F.lead("kind").over(w).alias("next_kind"), F.lead("value").over(w).alias("next_value"))
    return s.where(F.col("next_kind") != F.col("kind"))
