"""Exact similarity join of texts by their sets of character shingles, in comparing tasks of bounded size.

A set is stood for by a bit sketch: bit i is the parity of the number of its shingles that are dealt to i. A shingle
that only one of two sets has flips one bit, so the bits in which two sketches differ are never more than the shingles
in which the sets do, and no partner is lost. Sets of unlike texts differ in about half of the bits, and a sketch has
enough of them that this is more than partners may differ in.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a shingle; in the comparison form a character is a byte.
SIZE = 5
#: Bytes of sketches in a shard; two shards meet in a task.
SHARD_BYTES = 2 << 20
#: Shingles on one side of a block of pairs, which are compared and verified together, and its most rows.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, (64, 1024)
#: Bits of the number of a text, and of its group, among those that are compared together beside the 40 of a shingle.
SLICE_BITS = 11
#: Characters of texts that are compared together, unless a group has more.
SLICE_CHARS = 1 << 20


def shingles(norm: str) -> np.ndarray:
    """The distinct shingles of a comparison form as sorted numbers; a shorter text is one."""
    b = np.frombuffer(norm.encode(), dtype=np.uint8).astype(np.uint64)
    n = max(1, len(b) - SIZE + 1)
    s = np.zeros(n, np.uint64)
    for i in range(min(SIZE, len(b))):
        s += b[i : i + n] << np.uint64(8 * i)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _ratio(t: float) -> float:
    """Partners' sizes are in one class or in neighbouring ones: a class is wider than their sizes may differ."""
    return 1.02 / min(t, 0.95)


def _bits(grid: int, t: float) -> int:
    """Bits of the sketches that meet in a grid, a class and the next one: half of them are more than its partners may differ in."""
    most = (1 - t) / (1 + t) * 2 * _ratio(t) ** (grid + 1)
    return 64 * math.ceil((2.2 * most + 96) / 64)


def _sketch(s: np.ndarray, bits: int) -> bytes:
    h = s * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    at = ((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(t: float):
    def run(batches):
        for b in batches:
            k, grid, own, low = [], [], [], []
            for norm in b["norm"].to_pylist():
                s = shingles(norm)
                g = int(math.log(len(s)) / math.log(_ratio(t)))
                k.append(len(s))
                grid.append(g)
                own.append(_sketch(s, _bits(g, t)))
                low.append(_sketch(s, _bits(g - 1, t)))
            yield pa.RecordBatch.from_arrays([b["id"], b["norm"], pa.array(k, pa.int64()), pa.array(grid, pa.int32()), pa.array(own, pa.binary()), pa.array(low, pa.binary())], ["id", "norm", "k", "grid", "own", "low"])

    return run


def _runs(batches, keys: list[str]):
    """Rows that are sorted by the keys, as a table for each."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        key = np.stack([t[c].to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for i, j in pairwise(edges[:-1]):
            yield t.slice(i, j - i)
        rest = t.slice(edges[-2])
    if rest is not None:
        yield rest


def _close(ka, a, kb, b, t: float, same: bool):
    """Blocks (first row, first column, rows, columns) of pairs that may reach t; sizes rise, ``b`` has a row for each word."""
    share, i = (1 - t) / (1 + t), 0
    while i < len(ka):
        n = max(1, min(BLOCK_ROWS[0], BLOCK_SHINGLES // int(ka[i])))
        rows, words = ka[i : i + n], a[i : i + n]
        lo, hi = np.searchsorted(kb, t * rows[0] - 1e-6), np.searchsorted(kb, rows[-1] / t + 1e-6, "right")
        j = max(int(lo), i) if same else int(lo)
        while j < hi:
            m = max(1, min(BLOCK_ROWS[1], BLOCK_SHINGLES // int(kb[j])))
            cols = kb[j : min(j + m, hi)]
            differ = np.zeros((len(rows), len(cols)), np.uint32)
            for w in range(len(b)):
                differ += np.bitwise_count(words[:, w, None] ^ b[w, j : j + len(cols)])
            if differ.min() > share * (rows[-1] + cols[-1]) + 1e-6:
                j += m
                continue
            x, y = np.nonzero(differ <= share * (rows[:, None] + cols) + 1e-6)
            keep = np.minimum(rows[x], cols[y]) >= t * np.maximum(rows[x], cols[y]) - 1e-6
            if same:
                keep &= i + x < j + y
            if keep.any():
                yield i, j, i + x[keep], j + y[keep]
            j += m
        i += n


def _candidates(t: float):
    """For each block with pairs that may be partners: its texts, those of the rows with the columns that they meet."""

    def run(batches):
        for cell in _runs(batches, ["cell"]):
            k = cell["k"].to_numpy()
            words = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint64).reshape(len(k), -1)
            upper, second = (cell[c].to_numpy(zero_copy_only=False) for c in ("upper", "second"))
            order = np.argsort(k, kind="stable")
            own, up, one, two = ~upper[order], upper[order], ~second[order], second[order]
            if cell["diagonal"][0].as_py():
                parts = [(own, own), (own, up)]
            else:
                parts = [(own & one, own & two), (own & one, up & two), (own & two, up & one)]
            for p, (a, b) in enumerate(parts):
                a, b = order[a], order[b]
                ia, ib = cell["id"].take(pa.array(a)).combine_chunks(), cell["id"].take(pa.array(b)).combine_chunks()
                for i, j, x, y in _close(k[a], words[a], k[b], np.ascontiguousarray(words[b].T), t, parts[p][0] is parts[p][1]):
                    first = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
                    cols = np.unique(y)
                    n = len(first) + len(cols)
                    met = pa.ListArray.from_arrays(pa.array(np.concatenate((first, np.full(len(cols) + 1, len(x)))), pa.int32()), ib.take(pa.array(y)))
                    ids = pa.concat_arrays([ia.take(pa.array(x[first])), ib.take(pa.array(cols))])
                    block = [pa.array(np.full(n, v, np.int64)) for v in (cell["cell"][0].as_py(), p, i, j)]
                    yield pa.RecordBatch.from_arrays([*block, ids, met], ["cell", "part", "i", "j", "id", "met"])

    return run


def _verified(batches):
    """Pairs of each block with the sizes of their sets' common part and union."""
    for g in _runs(batches, ["cell", "part", "i", "j"]):
        ids = g["id"].to_pylist()
        sets = {i: shingles(n) for i, n in zip(ids, g["norm"].to_pylist(), strict=True)}
        names, place = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
        numbers = dict(zip(sets, np.split(place, np.cumsum([len(s) for s in sets.values()])[:-1]), strict=True))
        mark, a, b, common = np.zeros(len(names), bool), [], [], []
        for i, met in zip(ids, g["met"].to_pylist(), strict=True):
            mark[numbers[i]] = True
            for o in met:
                a.append(i)
                b.append(o)
                common.append(np.count_nonzero(mark[numbers[o]]))
            mark[numbers[i]] = False
        both = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(a, b, strict=True)], np.int64)
        common, kind = np.array(common, np.int64), g["id"].type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(common), pa.array(both - common)], ["a", "b", "common", "total"])


def _value(table: dict[int, int], key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x).cast(kind) for k, v in table.items() for x, kind in ((k, "int"), (v, "long"))]), F.col(key)) if table else F.lit(1).cast("long")


def similar_pairs(texts: DataFrame, folder: str, t: float) -> DataFrame:
    """Pairs (a, b, common, total) of rows (id, norm) whose shingle sets have common >= t * total; norm is a comparison form.

    What the driver holds is a row for each class of sizes, whose number is the logarithm of the longest text. Each pair
    of a grid's shards is a task, so a row moves as often as its grid has shards.
    """
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    kept = texts.mapInArrow(_sketches(t), f"id {kind}, norm string, k long, grid int, own binary, low binary")
    kept.write.parquet(folder)
    kept = spark.read.schema(kept.schema).parquet(folder)
    n = {r.grid: r.n for r in kept.groupBy("grid").agg(F.count("*").alias("n")).collect()}
    shards, start, cells = {}, {}, 0
    for g in sorted(n):
        shards[g], start[g] = -(-(n[g] + n.get(g + 1, 0)) * _bits(g, t) // 8 // SHARD_BYTES), cells
        cells += shards[g] ** 2
    own = kept.select("id", "k", "grid", F.col("own").alias("sketch"), F.lit(False).alias("upper"))
    low = kept.select("id", "k", (F.col("grid") - 1).alias("grid"), F.col("low").alias("sketch"), F.lit(True).alias("upper"))
    dealt = own.unionAll(low).where(F.col("grid").isin(list(n))).withColumns({"shards": _value(shards, "grid"), "start": _value(start, "grid")}).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    p, q = F.least("shard", "other"), F.greatest("shard", "other")
    rows = met.select("id", "k", "sketch", "upper", (F.col("start") + p * F.col("shards") + q).alias("cell"), (F.col("shard") > F.col("other")).alias("second"), (p == q).alias("diagonal"))
    block = ["cell", "part", "i", "j"]
    near = rows.repartition(max(cells, 1), "cell").sortWithinPartitions("cell").mapInArrow(_candidates(t), f"cell long, part long, i long, j long, id {kind}, met array<{kind}>")
    checked = near.join(kept.select("id", "norm"), "id").select(*block, "id", "norm", "met").repartition(*block).sortWithinPartitions(*block)
    return checked.mapInArrow(_verified, f"a {kind}, b {kind}, common long, total long").where(F.col("common") >= F.lit(t) * F.col("total") - 1e-9)


def _common(norm: list[bytes], group: np.ndarray):
    """(first, second, common, total) of each two texts of a group; the rows of a group, numbered from 0, lie together, 2 ** SLICE_BITS at most in all."""
    size = np.array([len(x) for x in norm], np.int64)
    data = np.frombuffer(b"".join(norm) + bytes(SIZE), np.uint8)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    n = np.maximum(size - SIZE + 1, 1)
    row = np.repeat(np.arange(len(norm)), n)
    at = np.arange(len(row)) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    code = np.zeros(len(row), np.uint64)
    for i in range(SIZE):
        code |= data[at + i].astype(np.uint64) << np.uint64(8 * i)
    for i in np.flatnonzero(size < SIZE):  # a shorter text is one shingle
        code[np.searchsorted(row, i)] = int.from_bytes(norm[i], "little")
    bits = np.uint64(SLICE_BITS)
    # Group, shingle, text: of a group, the texts with one shingle are neighbours.
    key = (group[row].astype(np.uint64) << (bits + np.uint64(8 * SIZE))) | (code << bits) | row.astype(np.uint64)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    same, row = key >> bits, (key & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)
    sets = np.bincount(row, minlength=len(norm))
    later = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1  # rows of its group behind a row
    base = np.concatenate(([0], np.cumsum(later)))
    common, d = np.zeros(base[-1], np.int64), 1
    while d < len(key):
        x = np.flatnonzero(same[d:] == same[:-d])
        if not len(x):
            break
        a, b = row[x], row[x + d]
        common += np.bincount(base[a] + b - a - 1, minlength=len(common))
        d += 1
    first = np.repeat(np.arange(len(norm)), later)
    second = np.arange(len(first)) - base[first] + first + 1
    return first, second, common, sets[first] + sets[second] - common


def _grouped(kind: pa.DataType):
    """Pairs inside groups, from rows (group, id, pos, norm) that are sorted by the group."""

    def pairs(t: pa.Table, group: np.ndarray, cross: int = 0):
        """Of rows of whole groups; with ``cross``, of the one group's pairs only those over this row."""
        first, second, common, total = _common([x.encode() for x in t["norm"].to_pylist()], group)
        pos = t["pos"].to_numpy()
        good = (pos[first] != pos[second]) & ((first < cross) & (second >= cross) if cross else True)
        first, second, common, total = (x[good] for x in (first, second, common, total))
        turned = pos[first] > pos[second]
        a, b = np.where(turned, second, first), np.where(turned, first, second)
        ids = t["id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)).cast(kind), ids.take(pa.array(b)).cast(kind), pa.array(common), pa.array(total)], ["a", "b", "common", "total"])

    def whole(t: pa.Table):
        """All pairs of whole groups."""
        group = t["group"].to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        chars = np.concatenate(([0], np.cumsum([len(x) for x in t["norm"].to_pylist()])))
        most, at = 1 << SLICE_BITS, 0
        while at < len(edges) - 1:
            lo = edges[at]
            upto = max(at + 1, min(np.searchsorted(edges, lo + most, "right") - 1, np.searchsorted(chars[edges], chars[lo] + SLICE_CHARS, "right") - 1))
            part = t.slice(lo, edges[upto] - lo)
            if len(part) <= most:
                yield pairs(part, np.repeat(np.arange(upto - at), np.diff(edges[at : upto + 1])))
            else:  # a group with more rows, two blocks of it at a time
                blocks = [part.slice(i, most // 2) for i in range(0, len(part), most // 2)]
                for i, x in enumerate(blocks):
                    yield pairs(x, np.zeros(len(x), np.int64))
                    for y in blocks[i + 1 :]:
                        yield pairs(pa.concat_tables([x, y]), np.zeros(len(x) + len(y), np.int64), len(x))
            at = upto

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            group = t["group"].to_numpy()
            end = np.searchsorted(group, group[-1])  # the last group may go on
            if end:
                yield from whole(t.slice(0, end))
            rest = t.slice(end)
        if rest is not None:
            yield from whole(rest)

    return run


def pairs_in_groups(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, common, total) of rows (group, id, pos, norm) of one group with a.pos < b.pos; a group is a number, its rows lie together in one task in the order of groups.

    The shingles of a text are made once, and those of many groups are sorted together.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    return rows.select("group", "id", "pos", "norm").where("`group` IS NOT NULL AND pos IS NOT NULL").mapInArrow(_grouped(to_arrow_type(kind)), f"a {kind.simpleString()}, b {kind.simpleString()}, common long, total long")
