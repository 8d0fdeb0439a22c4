"""Best-fit packing by large-item matching, decided on the histogram of lengths.

Pieces have at most ``capacity`` lengths, so the packing is decided on counts by length: a bounded
input on the driver whatever the size of the corpus, and as good as packing all pieces at once.

* Pieces above a third of the capacity pair at most twice a bin: from the longest on, each takes
  the longest remaining such piece that still fits (greedy matching).
* Smaller pieces, from the longest on, go to the fullest bin that still holds them (best fit).

The plan is a list of runs: "of length L, ranks lo to hi fill bins from b on, k in each, at offset
o". Each piece finds its rank among the pieces of its length by counts per (length, bucket) and a
rank inside the bucket, so that even a third of all pieces having one length spreads over buckets.

Defined results: a null or empty text is one piece with the end id alone; rows that repeat an id
are packed each; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts
from .tokens import encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: only documents longer than ``capacity`` are cut, and only their first piece is shorter."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            cols = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                cut = n % capacity or capacity
                for piece, (lo, hi) in enumerate(zip([0, *range(cut, n, capacity)], [*range(cut, n, capacity), n], strict=True)):
                    part = ids[4 * lo : 4 * hi]
                    for c, v in zip(cols, (doc_id, piece, lo, hi - lo, zlib.crc32(part), part), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds, strict=False)], names=names[:k])

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, lo, hi, first_bin, per_bin, offset) that place every piece.

    Bins with equal contents are kept as one group (first bin, number of bins, filled), so the
    work depends on the number of distinct lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (room, first bin, bins), sorted by room
    bins = 0

    def put(length: int, first: int, n_bins: int, k: int, offset: int, n: int) -> None:
        runs.append((length, rank[length], rank[length] + n, first, k, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # the longest, with the longest that fits beside it
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        room = capacity - a
        i = bisect_left(large, room + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        b = large[i] if i >= 0 else None
        if b is None:
            m = left[a]
            put(a, bins, m, 1, 0, m)
            insort(gaps, (room, bins, m))
        elif b == a:
            m = left[a] // 2
            if m:
                put(a, bins, m, 2, 0, 2 * m)
                insort(gaps, (room - a, bins, m))
            elif i > 0:  # one is left: it takes the next shorter one
                large.pop()
                b = next((x for x in reversed(large[:i]) if left[x]), None)
                m = 1
                put(a, bins, 1, 1, 0, 1)
                if b is not None:
                    put(b, bins, 1, 1, a, 1)
                insort(gaps, (room - (b or 0), bins, 1))
            else:
                m = 1
                put(a, bins, 1, 1, 0, 1)
                insort(gaps, (room, bins, 1))
        else:
            m = min(left[a], left[b])
            put(a, bins, m, 1, 0, m)
            put(b, bins, m, 1, a, m)
            insort(gaps, (room - b, bins, m))
        bins += m
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(gaps, (length, -1, -1))
            room, first, m = gaps.pop(i) if i < len(gaps) else (capacity, bins, -(-left[length] // (capacity // length)))
            bins = max(bins, first + m)
            k = room // length
            full = min(m, left[length] // k)
            if full:
                put(length, first, full, k, capacity - room, full * k)
                if room - k * length:
                    insort(gaps, (room - k * length, first, full))
            if full < m and left[length]:
                r = left[length]
                put(length, first + full, 1, r, capacity - room, r)
                insort(gaps, (room - r * length, first + full, 1))
                full += 1
            if full < m:
                insort(gaps, (room, first + full, m - full))
    return runs


def pack(items: DataFrame, capacity: int = 2048, bucket_rows: int = 20_000) -> DataFrame:
    """``items`` (with doc_id, piece, length, ids_crc32, stored so that it can be read twice) with sequence_id and offset."""
    spark = items.sparkSession
    n = items.count()
    n_buckets = max(1, min(64, n // 500), n // bucket_rows)
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    # At most some tens of thousands of runs: bounded by the capacity, not by the corpus.
    runs = spark.createDataFrame(plan(histogram, capacity), "r_length int, lo long, hi long, first_bin long, per_bin long, at long")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select(
        *items.columns,
        (F.col("first_bin") + F.floor(k / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs; one row per piece. Tokenising runs once: its pieces are stored in the shared folder."""
    items = materialize(pieces(docs, capacity, tokenizer, end_id, with_ids, id_col, text_col), "pieces")
    return pack(items, capacity).withColumn("length", F.col("length").cast("long"))
