"""Removal of repeated byte strings by a prefix-aware distributed merge sort of suffixes.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts anywhere else. Sorting
all suffixes would settle this, but equal strings of that length also agree on where their least
``GRAM``-byte hash lies, so one suffix per such anchor is enough:

1. One scan finds the anchors: maximal ranges lo..hi of window starts that share their least gram.
   A range's segment is text[lo : hi + LENGTH].
2. Anchors whose gram occurs once anywhere are dropped by an aggregation with map-side combine;
   the others are split by a hash of their segment into those with an equal one and edges.
3. Segments with an equal one are sorted by their bytes: every task sorts its own into a run, cuts it at
   sampled splitters, front-codes each part (common prefix length, rest) and sends it; each range
   is merged by a loser tree that compares only what lies beyond the known common prefixes. A segment
   is repeated when its neighbour begins with all its bytes: bytes decide, hashes only select.
   Splitters carry a tie-breaker, so equal segments of any number spread over several ranges.
4. An edge, a segment unlike all others of its gram, holds a place where repeated text begins or ends. The
   different segments of a gram meet (copies are represented by one) and their windows are
   compared, by hash and then by bytes, for the first and last repeated one. A gram with more than
   ``MOST_VARIANTS`` different segments is not gathered in a task: its windows are aggregated by hash,
   and the first and last of each segment are compared by bytes with another place of that hash.
5. The intervals join the texts.

Text of a short period (a run of dashes) would move the anchor with every byte. A gram that repeats
itself after at most ``PERIOD`` bytes is an anchor only where a window has no other, and of a periodic
stretch only the first three periods are sorted: every later window equals one of those, byte for byte.

Defined results: a null text is empty; matches never cross documents; overlaps count; rows that repeat
an id and a text are two places of the same string; texts shorter than ``LENGTH`` are untouched. Ids
are integers; rows with a null id are told apart by their text.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from .common import Rolling, materialize, mix64, remove, texts, word_spans

LENGTH, GRAM = 400, 128
SEGMENT = 1 << 18  # windows that are hashed at a time
PERIOD = 64
RANGE_BYTES = 24 << 20  # of segments in a range of the sort
SAMPLE = 32  # segments a range from which splitters are taken
SPLITTER_BYTES = 128 << 20  # of splitters as a worker holds them, which are broadcast; beyond it ranges are larger
SPLITTER_COST = 200  # bytes of a splitter beside its strings: two objects, a tuple, its place in the list and in the index of hot ones
RUN_BYTES = 16 << 20  # of segments that a task sorts at a time
MOST_TASKS = 20_000  # of the merge; a task merges several ranges one after the other
MOST_VARIANTS = 4096  # of a gram that one task compares
_PERIODIC = np.uint64(1 << 63)
_NO_ID = -(1 << 63)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of the leftmost least one, by doubling."""
    m = len(h) - width + 1
    at, v, size = np.arange(len(h), dtype=np.int32), h, 1
    while size * 2 <= width:
        left = v[:-size] <= v[size:]
        at = np.where(left, at[:-size], at[size:])
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    off = width - size
    return np.where(v[:m] <= v[off : off + m], at[:m], at[off : off + m]) if off else at[:m]


def _same_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading bytes are equal."""
    k, step, n = 0, 256, min(len(a), len(b))
    while k < n:
        x = np.flatnonzero(a[k : min(n, k + step)] != b[k : min(n, k + step)])
        if len(x):
            return k + int(x[0])
        k, step = k + step, 2 * step
    return n


def _stretches(data: np.ndarray, places: np.ndarray, gram: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches around those grams that repeat themselves after at most PERIOD bytes and half their length."""
    most = min(PERIOD, gram // 2, gram - 8)
    if most < 1 or not len(places):
        return []
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, most + 8)[places])
    eight = np.ndarray((len(places), most + 1), "<u8", heads, 0, (most + 8, 1))  # the 8 bytes from each place on
    again = eight[:, 1:] == eight[:, :1]
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(again.any(1)):
        at = int(places[i])
        if out and at + gram <= out[-1][1]:  # in the last stretch
            continue
        q = next((int(q) + 1 for q in np.flatnonzero(again[i]) if (data[at : at + gram - q - 1] == data[at + q + 1 : at + gram]).all()), 0)
        if q:
            out.append((at - _same_for(data[:at][::-1], data[q : at + q][::-1]), at + q + _same_for(data[at + q :], data[at : len(data) - q]), q))
    return out


def places_of(data: np.ndarray, length: int, gram: int):
    """Gram hashes, the anchor of every window, and the periodic stretches (start, end, period) that were met.

    The anchor is the leftmost least of the grams without a short period, or of all where a window has no other:
    a function of the window's bytes alone. Periodic grams are marked, stretch by stretch, until no anchor is one by surprise.
    """
    h = Rolling(data).windows(gram) & ~_PERIODIC
    stretches: list[tuple[int, int, int]] = []
    known = np.zeros(0, np.int64)
    while True:
        at = sliding_argmin(h, length - gram + 1)
        places = np.unique(at)
        places = places[h[places] < _PERIODIC]
        new = np.setdiff1d(places, known, assume_unique=True)
        met = _stretches(data, new, gram)
        if not met:
            return h, at, stretches
        known = np.union1d(known, new)
        for s, e, _ in met:
            h[s : e - gram + 1] |= _PERIODIC
        stretches += met


def anchors_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT):
    """Arrays lo, hi, gram hash, segment hash, proven of one text's bytes; proven ranges are repeated, the rest is to be sorted."""
    out = []
    for x in range(0, max(0, len(data) - length + 1), segment):
        part = data[x : x + segment + length - 1]
        h, at, stretches = places_of(part, length, gram)
        cut = np.flatnonzero(np.diff(at))
        lo, hi = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
        proven = np.zeros(len(lo), bool)
        for s, e, q in stretches:  # a window from the fourth period on equals the one a period before it
            i, j = np.searchsorted(lo, s + 3 * q), np.searchsorted(hi, e - length, "right")
            if i < j:
                proven[i] = True
                hi[i] = hi[j - 1]
                keep = np.ones(len(lo), bool)
                keep[i + 1 : j] = False
                lo, hi, proven = lo[keep], hi[keep], proven[keep]
        s = mix64(Rolling(part).spans(lo, hi + length) * np.uint64(0x9E3779B97F4A7C15) + (at[lo] - lo).astype(np.uint64))
        out.append((lo + x, hi + x, h[at[lo]].view(np.int64), s.view(np.int64), proven))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, tie name a document: its id (null: the least long) and a hash of its text."""
    d = texts(docs, id_col, text_col)
    return d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("tie"), "text")


def find_anchors(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows did, tie, lo, hi, g, s; g is null where the range is known to be repeated."""

    def run(batches):
        for b in batches:
            for did, tie, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                if (a := anchors_of(data, length, gram)) is not None:
                    n = len(a[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, did)), pa.array(np.full(n, tie)), pa.array(a[0]), pa.array(a[1]), pa.array(a[2], mask=a[4]), pa.array(a[3])], names=["did", "tie", "lo", "hi", "g", "s"]
                    )

    def packed(batches):  # one batch for many small texts
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    binary = keyed.where(F.octet_length("text") >= length).select("did", "tie", F.col("text").cast("binary").alias("text"))
    return binary.mapInArrow(packed, "did long, tie long, lo long, hi long, g long, s long")


# The sort


def common_prefix(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, which is known to be at least ``h``."""
    n = min(len(a), len(b))
    while h < n:
        x, y = a[h : h + 64], b[h : h + 64]
        if x != y:
            k = min(len(x), len(y))
            d = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return h + (k - (d.bit_length() + 7) // 8 if d else k)
        h += 64
    return n


def front_code(run: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (segment, payload of 24 bytes) as common prefix length, rest length, payload, rest."""
    out, last = bytearray(), b""
    for seg, payload in run:
        h = common_prefix(last, seg, 0)
        out += h.to_bytes(3, "little") + (len(seg) - h).to_bytes(3, "little") + payload + seg[h:]
        last = seg
    return zlib.compress(bytes(out), 1)


def decode_run(block: bytes):
    """(prefix shared with the one before, segment, payload) of a front-coded run."""
    data, at, seg = zlib.decompress(block), 0, b""
    while at < len(data):
        h = int.from_bytes(data[at : at + 3], "little")
        n = int.from_bytes(data[at + 3 : at + 6], "little")
        payload = data[at + 6 : at + 30]
        at += 30 + n
        seg = seg[:h] + data[at - n : at]
        yield h, seg, payload


def merge_runs(runs: list):
    """(segment, payload, prefix shared with the one before) in order, from iterators of decode_run.

    A loser tree: each inner node keeps the loser of its match and the prefix it shares with the
    winner. All candidates on a winner's path share known prefixes with that winner, so the longer
    one is the smaller, and bytes are compared beyond the prefix only where both are equally long.
    """
    k = 1
    while k < len(runs):
        k *= 2
    runs = [*runs, *(iter(()) for _ in range(k - len(runs)))]
    seg: list[bytes | None] = [None] * k
    load: list[bytes] = [b""] * k

    def pull(i: int) -> int:
        for h, s, p in runs[i]:
            seg[i], load[i] = s, p
            return h
        seg[i] = None
        return -1

    def play(a: int, ha: int, b: int, hb: int):
        """Winner, its prefix with the last output, loser, its prefix with the winner."""
        if seg[a] is None:
            return b, hb, a, -1
        if seg[b] is None:
            return a, ha, b, -1
        if ha != hb:
            return (a, ha, b, hb) if ha > hb else (b, hb, a, ha)
        x, y = seg[a], seg[b]
        h = common_prefix(x, y, ha)
        if h == len(x) or h < len(y) and x[h] < y[h]:
            return a, ha, b, h
        return b, hb, a, h

    tree: list[tuple[int, int]] = [(0, -1)] * k
    winners = [(0, 0)] * k + [(i, 0) for i in range(k)]
    for i in range(k):
        pull(i)
    for node in range(k - 1, 0, -1):
        w, hw, lost, hl = play(*winners[2 * node], *winners[2 * node + 1])
        winners[node], tree[node] = (w, hw), (lost, hl)
    w, hw = winners[1] if k > 1 else (0, 0)
    while seg[w] is not None:
        yield seg[w], load[w], hw
        hw, node = pull(w), (w + k) // 2
        while node:
            w, hw, lost, hl = play(w, hw, *tree[node])
            tree[node] = (lost, hl)
            node //= 2


def repeated_of(merged) -> list[bytes]:
    """Payloads of the segments that a neighbour begins with; a payload of id zero bytes in front is a witness."""
    out, last, hit = [], None, False
    for s, payload, h in merged:
        if last is not None:
            after = h >= len(last[0])  # the next one begins with all of the last
            if hit or after:
                out.append(last[1])
            hit = h >= len(s)
        last = (s, payload)
    if last is not None and hit:
        out.append(last[1])
    return out


def separators(items: list[tuple[bytes, bytes]], every: int) -> list[tuple[bytes, bytes]]:
    """Of sorted items, for each ``every``-th: the shortest string that is above the item before it, or itself where they have one segment."""
    out = []
    for i in range(every // 2, len(items), every):
        seg, last = items[i][0], items[i - 1][0] if i else b""
        out.append(items[i] if i and seg == last else (seg[: common_prefix(last, seg, 0) + 1], b""))
    return sorted(set(out))


def hot_segments(splitters: list[tuple[bytes, bytes]]) -> dict[bytes, range]:
    """The ranges over which a segment that is itself a splitter spreads."""
    out: dict[bytes, range] = {}
    for r, (seg, payload) in enumerate(splitters):
        if payload:
            out[seg] = range(out[seg].start if seg in out else r, r + 2)
    return out


def cut_runs(items: list[tuple[bytes, bytes]], splitters: list[tuple[bytes, bytes]], hot: dict[bytes, range]) -> list[tuple[int, bytes]]:
    """Sorts a task's segments and front-codes its part of each range; a hot segment gets a witness in each range it spans.

    A payload begins with a tie-breaker, so (segment, payload) orders equal segments; only the
    segment is compared when ranges are merged.
    """
    items.sort()
    parts: dict[int, list[tuple[bytes, bytes]]] = {}
    for it in items:
        parts.setdefault(bisect.bisect_right(splitters, it), []).append(it)
    for seg, spans in hot.items():
        lo, hi = bisect.bisect_left(items, (seg, b"")), bisect.bisect_right(items, (seg, b"\xff" * 25))
        for to in spans if lo < hi else ():
            if any(bisect.bisect_right(splitters, items[i]) != to for i in (lo, hi - 1)):
                bisect.insort(parts.setdefault(to, []), (seg, b"\0" * 24))
    return [(r, front_code(p)) for r, p in sorted(parts.items())]


# The edges


def edge_windows(segs: list[bytes], single: list[bool], offsets: list[int], length: int) -> list[tuple[int, int] | None]:
    """First and last repeated window start (inside its segment) of each single segment of one gram.

    offsets: where each segment's window 0 starts relative to the gram. Equal windows have equal
    distance from the gram, so windows are compared by (distance, hash), then by bytes.
    """
    hashes, owner, start = [], [], []
    for i, s in enumerate(segs):
        data = np.frombuffer(s, np.uint8)
        hashes.append(Rolling(data).windows(length) + (np.arange(len(data) - length + 1) + offsets[i]).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        owner.append(np.full(len(hashes[-1]), i))
        start.append(np.arange(len(hashes[-1])))
    h, owner, start = np.concatenate(hashes), np.concatenate(owner), np.concatenate(start)
    order = np.argsort(h, kind="stable")
    h, owner, start = h[order], owner[order], start[order]
    same = np.concatenate(([False], h[1:] == h[:-1], [False]))
    rep = np.flatnonzero(same[1:] | same[:-1])
    partner = np.where(same[rep], rep - 1, rep + 1)
    out: list[tuple[int, int] | None] = [None] * len(segs)
    by = np.lexsort((start[rep], owner[rep]))
    for i, rows in zip(*_groups(owner[rep][by], by), strict=True):
        if not single[i]:
            continue
        proven = lambda k: segs[i][start[rep[k]] : start[rep[k]] + length] == segs[owner[partner[k]]][start[partner[k]] : start[partner[k]] + length]  # noqa: B023, E731
        first = next((k for k in rows if proven(k)), None)
        if first is not None:
            last = next(k for k in rows[::-1] if proven(k))
            out[i] = (int(start[rep[first]]), int(start[rep[last]]))
    return out


def _groups(keys: np.ndarray, values: np.ndarray):
    if not len(keys):
        return [], []
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate(([0], cut))].tolist(), np.split(values, cut)


_SPAN = "did long, tie long, lo long, hi long"


def _payload(did: int, tie: int, lo: int) -> bytes:
    """A tie-breaker of 4 bytes (never 0), then what names the segment."""
    x = did.to_bytes(8, "little", signed=True) + tie.to_bytes(8, "little", signed=True) + lo.to_bytes(4, "little")
    return (zlib.crc32(x) or 1).to_bytes(4, "big") + x


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_variants: int = MOST_VARIANTS, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, tie, lo, hi): byte ranges that are to go, not yet merged; see _keyed for did and tie. Stored; what led to it is deleted."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    found = materialize(find_anchors(keyed, length, gram), "anchors")
    direct = materialize(found.where("g is null").select("did", "tie", "lo", (F.col("hi") + length).alias("hi")), "direct")
    # Stored, so that both sides of the join are plain exchanges, whose large partitions can be split.
    grams = materialize(found.where("g is not null").groupBy("g").agg(F.count("*").alias("gn")).where("gn > 1").select("g"), "grams")
    alive = materialize(found.join(grams, "g"), "alive")
    remove(spark, found)
    remove(spark, grams)
    me = F.xxhash64("did", "tie", "lo")
    per_kind = materialize(alive.groupBy("g", "s").agg(F.count("*").alias("n"), F.min(me).alias("rep")), "kinds")
    variants = per_kind.groupBy("g").agg(F.count("*").alias("k")).where("k > 1")
    kinds = materialize(per_kind.join(variants, "g", "left"), "kinds")
    remove(spark, per_kind)
    # item: goes into the sort. meets: goes to its gram's edge comparison.
    judged = alive.join(kinds, ["g", "s"]).select(
        "did", "tie", F.struct("lo", "hi", "g", "k", (F.col("n") > 1).alias("item"), (F.col("k").isNotNull() & ((F.col("n") == 1) | (F.col("rep") == me))).alias("meets")).alias("a")
    )
    per_doc = materialize(judged.where("a.item or a.meets").groupBy("did", "tie").agg(F.collect_set("a").alias("a")), "per-doc")
    remove(spark, kinds)
    splitters = _splitters(keyed, alive, length, range_bytes)
    remove(spark, alive)
    shared = spark.sparkContext.broadcast(splitters)  # at most SPLITTER_BYTES

    def send(batches):
        """Kind 0: a front-coded part of a run for range ``key``. Kind 1: a segment for the comparison of gram ``key``."""
        names = ["kind", "key", "did", "tie", "lo", "k", "single", "seg"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        items, size, hot = [], 0, hot_segments(shared.value)

        def runs():
            parts = cut_runs(items, shared.value, hot)
            items.clear()
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([0] * n, [p[0] for p in parts], *[[None] * n] * 5, [p[1] for p in parts]), types, strict=True)], names=names)

        for b in batches:
            rows: list[list] = [[] for _ in names]
            for did, tie, t, marks in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for a in marks:
                    seg = t[a["lo"] : a["hi"] + length]
                    if a["item"]:
                        items.append((seg, _payload(did, tie, a["lo"])))
                        size += len(seg) + 100
                    if a["meets"]:
                        for c, v in zip(rows, (1, a["g"], did, tie, a["lo"], a["k"], not a["item"], seg), strict=True):
                            c.append(v)
                if size >= RUN_BYTES:
                    yield runs()
                    size = 0
                if len(rows[0]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
        if items:
            yield runs()

    marked = keyed.join(per_doc, ["did", "tie"]).select("did", "tie", F.col("text").cast("binary").alias("text"), "a")
    sent = materialize(marked.mapInArrow(send, "kind int, key long, did long, tie long, lo long, k long, single boolean, seg binary"), "runs")

    def merge(batches):
        def done(blocks):
            hits = [p for p in repeated_of(merge_runs([decode_run(x) for x in blocks])) if p[:4] != b"\0\0\0\0"]
            cols = [[int.from_bytes(p[4:12], "little", signed=True) for p in hits], [int.from_bytes(p[12:20], "little", signed=True) for p in hits], [int.from_bytes(p[20:24], "little") for p in hits]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["did", "tie", "lo"])

        at, blocks = None, []
        for b in batches:
            for key, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != at and blocks:
                    yield done(blocks)
                    blocks = []
                at = key
                blocks.append(block)
        if blocks:
            yield done(blocks)

    ranges = sent.where("kind = 0").select("key", "seg").repartition(min(MOST_TASKS, len(splitters) + 1), "key").sortWithinPartitions("key")
    sorted_hits = ranges.mapInArrow(merge, "did long, tie long, lo long")
    ends = per_doc.select("did", "tie", F.explode("a").alias("a")).where("a.item").select("did", "tie", "a.lo", (F.col("a.hi") + length).alias("hi"))
    whole = sorted_hits.join(ends, ["did", "tie", "lo"]).select("did", "tie", "lo", "hi")

    def compare(batches):
        def done(rows):
            segs = [r[4] for r in rows]
            at = [int(places_of(np.frombuffer(s[:length], np.uint8), length, gram)[1][0]) for s in segs]  # where the gram lies
            out = [(r[0], r[1], r[2] + e[0], r[2] + e[1] + length) for r, e in zip(rows, edge_windows(segs, [r[3] for r in rows], [-x for x in at], length), strict=True) if e]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["did", "tie", "lo", "hi"])

        at, rows = None, []
        for b in batches:
            for key, *row in zip(*(b.column(n).to_pylist() for n in ("key", "did", "tie", "lo", "single", "seg")), strict=True):
                if key != at and rows:
                    yield done(rows)
                    rows = []
                at = key
                rows.append(row)
        if rows:
            yield done(rows)

    edges = sent.where("kind = 1")
    few = edges.where(F.col("k") <= most_variants).select("key", "did", "tie", "lo", "single", "seg").repartition("key").sortWithinPartitions("key")
    spans = whole.unionByName(few.mapInArrow(compare, _SPAN)).unionByName(direct)
    many = edges.where(F.col("k") > most_variants).select("did", "tie", "lo", "single", "seg")
    if not many.isEmpty():
        spans = spans.unionByName(_many_variants(many, length))
    spans = materialize(spans, "spans")
    for x in (per_doc, sent, direct):
        remove(spark, x)
    return spans


def _window_hashes(seg: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window: one of its bytes, one of its bytes from the end."""
    data = np.frombuffer(seg, np.uint8)
    return Rolling(data).windows(length).view(np.int64), Rolling(data[::-1].copy()).windows(length)[::-1].copy().view(np.int64)


def _many_variants(edges: DataFrame, length: int, hashes=_window_hashes) -> DataFrame:
    """The edge comparison of grams with very many variants: an aggregation over window hashes, then bytes.

    The first and the last window of a segment whose hash occurs twice are compared with another
    place of that hash. Should they differ, all places of the segment's hashes are grouped by bytes.
    """
    place = ["did", "tie", "lo", "p"]

    def windows(batches):
        for b in batches:
            for did, tie, lo, single, seg in zip(*(b.column(n).to_pylist() for n in ("did", "tie", "lo", "single", "seg")), strict=True):
                n = len(seg) - length + 1
                arrays = [*hashes(seg, length), np.full(n, did), np.full(n, tie), np.full(n, lo), np.arange(n) + lo]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays] + [pa.array(np.full(n, single))], names=["w", "v", *place, "single"])

    segments = edges.dropDuplicates(["did", "tie", "lo"]).select("did", "tie", "lo", "seg")

    def with_bytes(rows: DataFrame) -> DataFrame:
        return rows.join(segments, ["did", "tie", "lo"]).withColumn("bytes", F.expr(f"substring(seg, cast(p - lo + 1 as int), {length})")).drop("seg")

    w = edges.mapInArrow(windows, "w long, v long, did long, tie long, lo long, p long, single boolean")
    twice = materialize(w.groupBy("w", "v").agg(F.count("*").alias("n")).where("n > 1").select("w", "v"), "windows")
    hit = materialize(w.where("single").join(twice, ["w", "v"]).select("w", "v", *place), "hits")
    ends = hit.groupBy("did", "tie", "lo").agg(F.array_distinct(F.array(F.min(F.struct("p", "w", "v")), F.max(F.struct("p", "w", "v")))).alias("e"))
    ends = materialize(with_bytes(ends.select("did", "tie", "lo", F.explode("e").alias("e")).select("did", "tie", "lo", "e.*")), "ends")
    # Two places of each hash; one of them is another than the end itself.
    two = w.join(ends.select("w", "v").distinct(), ["w", "v"]).groupBy("w", "v").agg(F.array(F.min(F.struct(*place)), F.max(F.struct(*place))).alias("o"))
    others = with_bytes(two.select("w", "v", F.explode("o").alias("o")).select("w", "v", "o.*")).select("w", "v", F.struct(*place).alias("other"), F.col("bytes").alias("theirs"))
    other = (F.struct(*place) != F.col("other")) & (F.col("bytes") == F.col("theirs"))
    proven = ends.join(others, ["w", "v"]).groupBy(*place).agg(F.max(other).alias("ok")).groupBy("did", "tie", "lo").agg(F.min("ok").alias("ok"), F.min("p").alias("first"), (F.max("p") + length).alias("end"))
    proven = materialize(proven, "proven")
    out = proven.where("ok").select("did", "tie", F.col("first").alias("lo"), F.col("end").alias("hi"))
    doubt = proven.where("not ok").select("did", "tie", "lo")
    if not doubt.isEmpty():
        theirs = hit.join(doubt, ["did", "tie", "lo"])
        equal = with_bytes(w.join(theirs.select("w", "v").distinct(), ["w", "v"]).select("w", "v", *place).distinct()).groupBy("w", "v", "bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        settled = with_bytes(theirs).join(equal, ["w", "v", "bytes"]).groupBy("did", "tie", F.col("lo").alias("at")).agg(F.min("p").alias("lo"), (F.max("p") + length).alias("hi"))
        out = out.unionByName(settled.select("did", "tie", "lo", "hi"))
    return out


def _splitters(keyed: DataFrame, alive: DataFrame, length: int, range_bytes: int) -> list[tuple[bytes, bytes]]:
    """Boundaries of the ranges, as many as the segments that will be sorted fill ranges.

    The segments of a share of the documents are sorted by the cluster, and every task cuts its
    part; only the cuts, short strings, come to the driver.
    """
    n = alive.count()
    ranges = n * (length + 100) // range_bytes
    if not ranges:
        return []
    # Eight times the documents by a hash, so that both sides are cut before they move, and an eighth of their segments.
    mine = F.pmod(F.xxhash64("tie", "did"), F.lit(n)) < 8 * SAMPLE * ranges
    some = keyed.where(mine).join(alive.where(mine & (F.pmod(F.xxhash64("lo", "did"), F.lit(8)) == 0)).select("did", "tie", "lo", "hi"), ["did", "tie"])
    cut = some.select("did", "tie", "lo", F.expr(f"substring(cast(text as binary), cast(lo + 1 as int), cast(hi - lo + {length} as int))").alias("seg")).distinct()
    cut = materialize(cut, "sample")
    taken = cut.count()
    every = max(1, taken // ranges)

    def run(batches):
        items = [(seg, _payload(did, tie, lo)) for b in batches for did, tie, lo, seg in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got = separators(sorted(items), every)
        yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.binary()) for i in range(2)), pa.array(range(len(got)), pa.int64())], names=["seg", "payload", "at"])

    spark = keyed.sparkSession
    tasks = max(1, min(MOST_TASKS, taken // 20_000))
    cuts = materialize(cut.repartitionByRange(tasks, "seg", "did", "tie", "lo").mapInArrow(run, "seg binary, payload binary, at long"), "cuts")
    remove(spark, cut)
    got = thinned(cuts, SPLITTER_BYTES).collect()
    remove(spark, cuts)
    return sorted({(bytes(r["seg"]), bytes(r["payload"])) for r in got})


def thinned(cuts: DataFrame, most: int) -> DataFrame:
    """(seg, payload): every cut, or of each task's every second, fourth, ... until what they take in memory is within ``most`` bytes.

    cuts: seg, payload, at (the number of a cut in its task). Ranges only become larger; if one cut a
    task is still too much, tasks are thinned by a hash.
    """
    size = F.length("seg") + F.length("payload") + SPLITTER_COST
    by_place = [F.col("at") % (1 << i) == 0 for i in range(40)]
    by_task = [by_place[-1] & (F.pmod(F.xxhash64("seg", "payload"), F.lit(1 << i)) == 0) for i in range(1, 40)]
    steps = [*by_place, *by_task]
    sums = cuts.agg(*[F.coalesce(F.sum(F.when(s, size)), F.lit(0)) for s in steps]).first()
    return cuts.where(next((s for s, total in zip(steps, sums, strict=True) if total <= most), F.lit(False))).select("seg", "payload")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, carried: DataFrame, fields: list, row, min_words: int = 0, **params) -> DataFrame:
    """``carried`` (did, tie, text as bytes, row) with each document's merged spans; ``row(text bytes, spans)`` gives the new columns.

    Spans of fewer than ``min_words`` words do not count.
    """
    spans = repeated_spans(docs, **params)
    per_doc = materialize(spans.groupBy("did", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    remove(docs.sparkSession, spans)
    j = carried.join(per_doc, ["did", "tie"], "left").select("text", "spans", "row")
    new = pa.schema(fields)

    def run(batches):
        for b in batches:
            out = []
            for x, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                merged = merge_spans([(s["lo"], s["hi"]) for s in m or ()])
                if min_words:
                    merged = [(lo, hi) for lo, hi in merged if len(word_spans(np.frombuffer(x[lo:hi], np.uint8))[0]) >= min_words]
                out.append(row(x, merged))
            yield pa.RecordBatch.from_arrays([b.column(2), *(pa.array([o[i] for o in out], f.type) for i, f in enumerate(new))], names=["row", *new.names])

    return j.mapInArrow(run, StructType([j.schema["row"], *from_arrow_schema(new).fields]))


def _carried(docs: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """Each row's document, text as bytes, and the columns that it keeps, packed so that no name can clash."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = F.struct(F.col(f"`{text_col}`").isNull().alias("is_null"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("of"))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(t).alias("tie"), t.cast("binary").alias("text"), kept.alias("row"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans, kept_sha256, spans (the removed byte ranges)."""

    def row(data, spans):
        return len(data), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(_cut(data, spans)).hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in spans]

    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
    out = _with_spans(docs, _carried(docs, [id_col], id_col, text_col), fields, row, id_col=id_col, text_col=text_col, **params)
    return out.select(F.col(f"row.of.`{id_col}`").alias(id_col), *[f[0] for f in fields])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", **params) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, all other columns as they are.

    A character that loses some of its bytes goes as a whole; ``count_col``, where there is one,
    becomes the number of characters left; a null text stays null. Columns may have any names.
    """

    def row(data, spans):
        return (_cut(data, spans).decode("utf-8", "ignore") if spans else data.decode("utf-8", "replace"),)

    keep = [c for c in docs.columns if c != text_col]
    out = _with_spans(docs, _carried(docs, keep, id_col, text_col), [("new", pa.string())], row, id_col=id_col, text_col=text_col, **params)

    def column(c: str):
        if c == text_col:
            return F.when(~F.col("row.is_null"), F.col("new"))
        own = F.col(f"row.of.`{c}`")
        return F.when(F.col("row.is_null"), own).otherwise(F.length("new").cast(docs.schema[c].dataType)) if c == count_col else own

    return out.select(*[column(c).alias(c) for c in docs.columns])
