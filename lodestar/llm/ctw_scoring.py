"""Language-model scores by context-tree weighting over bytes.

A text is its words (ASCII capitals lowered) joined by one space, then a line feed as its end. Every byte is
eight binary decisions, each with a context tree of its own over the ``DEPTH`` bytes before (a text
begins after line feeds). A node holds the counts n0, n1 of its bit in the training texts and their
Krichevsky-Trofimov probability Pe; Pw = (Pe + product of Pw over longer contexts) / 2, at full depth Pw = Pe.
A bit is predicted by the mixture over all depths in which a node weighs Pe / (2 Pw), as a further bit would
be by the whole tree. All counts come from all training texts; nothing is pruned, capped or sampled.

Nothing is broadcast or collected that grows with the corpus, but for the two upper levels of the trees, which the
alphabet bounds (below 41,000 pairs of neighbouring bytes in UTF-8, 255 nodes each):

1. Texts are gathered in chunks of some MB, normalised, stored once.
2. A chunk asks for its distinct grams (DEPTH bytes and the next one, 48 bits, so no collisions) and its distinct
   words (64-bit hashes), each with its count in training texts. What it asks is cut by slab: a slab holds all
   grams whose last three context bytes hash to it, so every subtree below these is whole in one slab.
3. A slab adds up the counts of all chunks in a stream, and computes the weights of its subtrees; sums for
   each pair of bytes give the levels above. Then it evaluates every gram of it once.
4. Slabs answer chunks: the probability of each gram, the count of each word. A chunk scores its texts.

The sizes of chunks and slabs are parameters; slabs grow in number with the corpus.

Words are told apart by 64-bit hashes, so two of ten billion words would share a count by chance; grams are exact.

Defined results: null and empty texts are the end alone; a null id counts as the empty text when texts are held
out; every row gives a row, repeated ids too; without training texts every bit has probability one half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, materialize, mix64, remove

DEPTH, UNIT, TOP = 5, 3, 2
CHUNK_BYTES, SLAB_BYTES, MOST_SLABS = 16 << 20, 16 << 20, 4096
#: Bytes of a chunk that are worked on at a time.
PART = 1 << 20
GRAMS, WORDS = 0, 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text: str | None) -> bytes:
    """Words in lower case (ASCII), one space between, a line feed at the end; bytes split at ASCII white space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()) + b"\n"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True)


def _unpack(b: bytes, n: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(b, n, np.uint64), dtype=np.uint64)


# --- trees ---------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, shifted to arguments of 8 and more."""
    y, shift = x.astype(float), np.zeros(len(x))
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Of every pair of counts; equal pairs are worked out once."""
    pair, inverse = np.unique(np.column_stack((n0, n1)), axis=0, return_inverse=True) if len(n0) else (np.zeros((0, 2)), np.zeros(0, np.int64))
    a, b = pair[:, 0].astype(float), pair[:, 1].astype(float)
    out = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)
    out[(a == 0) & (b == 0)] = 0.0
    return out[inverse.ravel()]


def _half_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) - math.log(2)


class _Level:
    """One depth: sorted (context << 8 | byte) with counts, and for each of the 8 bits the nodes they fall in."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.node, self.first, self.n0, self.n1 = [], [], [], []
        for j in range(8):
            of = keys >> np.uint64(8 - j)
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            bit = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
            self.node.append(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys)))))
            self.first.append(start)
            self.n1.append(np.add.reduceat(np.where(bit, n, 0), start))
            self.n0.append(np.add.reduceat(np.where(bit, 0, n), start))


def _parents(level: _Level) -> tuple[_Level, np.ndarray]:
    """The level above: contexts without their farthest byte; and where each row goes."""
    up = (level.keys >> np.uint64(16) << np.uint64(8)) | (level.keys & np.uint64(255))
    keys, inverse = np.unique(up, return_inverse=True)
    return _Level(keys, np.bincount(inverse, weights=level.n, minlength=len(keys)).astype(np.int64)), inverse


class Subtrees:
    """All trees below contexts of UNIT bytes, of sorted grams (nearest context byte first, the byte last) with their counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.levels, self.up = [_Level(keys, n)], []
        for _ in range(depth - UNIT):
            level, up = _parents(self.levels[-1])
            self.levels.append(level)
            self.up.append(up)
        self.pe = [[_log_kt(lv.n0[j], lv.n1[j]) for j in range(8)] for lv in self.levels]
        self.pw = [self.pe[0]]
        for i, lv in enumerate(self.levels[1:]):
            below, up = self.levels[i], self.up[i]
            row = []
            for j in range(8):
                parent = lv.node[j][up[below.first[j]]]
                row.append(_half_sum(self.pe[i + 1][j], np.bincount(parent, weights=self.pw[i][j], minlength=len(lv.first[j]))))
            self.pw.append(row)

    def roots(self) -> tuple[np.ndarray, ...]:
        """(context of TOP bytes << 8 | node, n0, n1, sum of log Pw) over the subtrees of each."""
        lv, parts = self.levels[-1], []
        for j in range(8):
            k = lv.keys[lv.first[j]]
            node = np.uint64(1 << j) | ((k & np.uint64(255)) >> np.uint64(8 - j))
            parts.append((k >> np.uint64(8 + 8 * (UNIT - TOP)) << np.uint64(8) | node, lv.n0[j], lv.n1[j], self.pw[-1][j]))
        k, n0, n1, w = (np.concatenate(p) for p in zip(*parts, strict=True))
        keys, inverse = np.unique(k, return_inverse=True)
        return keys, *(np.bincount(inverse, weights=x, minlength=len(keys)) for x in (n0, n1, w))

    def log10(self, top: Top) -> np.ndarray:
        """Of every gram."""
        keys, out = self.levels[0].keys, np.zeros(len(self.levels[0].keys))
        rows = [np.arange(len(keys))]
        for up in self.up:
            rows.append(up[rows[-1]])
        for j in range(8):
            bit = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
            p = None
            for i, lv in enumerate(self.levels):
                at = lv.node[j][rows[i]]
                n0, n1 = lv.n0[j][at], lv.n1[j][at]
                kt = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1)
                w = np.exp(self.pe[i][j][at] - self.pw[i][j][at] - math.log(2)) if i else None
                p = kt if p is None else w * kt + (1 - w) * p
            node = np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
            one, rest = top.at(keys >> np.uint64(8 * (UNIT + len(self.up) - TOP) + 8) << np.uint64(8) | node)
            out += np.log10(np.where(bit, one, 1 - rest - one) + rest * p)
        return out


class Top:
    """The levels of at most TOP context bytes: for every node there P(1) = one + rest * (P(1) of the longer contexts)."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray):
        order = np.argsort(keys)
        keys, n0, n1, children = keys[order], n0[order], n1[order], children[order]
        self.keys, level = keys, []
        for d in range(TOP, -1, -1):
            pe = _log_kt(n0, n1)
            pw = _half_sum(pe, children)
            level.append((np.exp(pe - pw - math.log(2)), (n1 + 0.5) / (n0 + n1 + 1)))
            if d:
                up, inverse = np.unique(keys >> np.uint64(16) << np.uint64(8) | (keys & np.uint64(255)), return_inverse=True)
                level[-1] += (inverse,)
                n0, n1, children = (np.bincount(inverse, weights=x, minlength=len(up)) for x in (n0, n1, pw))
                keys = up
        w, kt = level[-1]
        one, rest = w * kt, 1 - w
        for w, kt, inverse in reversed(level[:-1]):
            one, rest = one[inverse], rest[inverse]
            one, rest = one + rest * w * kt, rest * (1 - w)
        self.one, self.rest = one, rest

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        return self.one[i], self.rest[i]


# --- grams and words of a chunk -----------------------------------------------------------------------

#: The hash of the end of a text.
END = np.uint64(1)


def gram_keys(data: np.ndarray, depth: int) -> np.ndarray:
    """For every place from ``depth`` on: the context, nearest byte first, then the byte."""
    n = len(data) - depth
    k = np.zeros(n, np.uint64)
    for back in range(1, depth + 1):
        k = (k << np.uint64(8)) | data[depth - back : depth - back + n]
    return (k << np.uint64(8)) | data[depth:]


def _parts(n: int, depth: int):
    """First place and place after the last of the pieces of a chunk, in which every text stands after ``depth`` line feeds."""
    for at in range(depth, n, PART):
        yield at, min(n, at + PART)


def _texts_at(lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the texts of a chunk."""
    ends = np.cumsum(lengths + depth)
    return ends - lengths, ends


def _add(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    keys, n = (np.concatenate(p) for p in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(keys) else n


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens that end in these whole words and ends, and where each ends; an empty text is an end alone."""
    gap = np.flatnonzero((data == 32) | (data == 10))
    start = np.concatenate(([0], gap[:-1] + 1))
    word = gap > start
    at = np.sort(np.concatenate((gap[word], gap[data[gap] == 10])), kind="stable")
    is_end = np.concatenate(([False], at[1:] == at[:-1])) | ((data[at] == 10) & ~np.isin(at, gap[word]))
    hashes = np.empty(len(at), np.uint64)
    hashes[~is_end] = Rolling(data).spans(start[word], gap[word])
    hashes[is_end] = END
    return hashes, at


def _gather(data: np.ndarray, lengths: np.ndarray, trained: np.ndarray, depth: int):
    """Distinct grams and words of a chunk with their counts in training texts."""
    starts, ends = _texts_at(lengths, depth)
    grams, words = [], []
    for lo, hi in _parts(len(data), depth):
        doc = np.searchsorted(ends, np.arange(lo, hi), "right")
        inside = np.arange(lo, hi) >= starts[doc]
        train = trained[doc[inside]]
        keys = gram_keys(data[lo - depth : hi], depth)[inside]
        part = [np.unique(keys[train], return_counts=True), (np.unique(keys[~train]), np.int64(0))]
        grams += [(k, np.broadcast_to(n, len(k))) for k, n in part]
        if sum(len(g[0]) for g in grams) > 1 << 21:
            grams = [_add(grams)]
    for lo, hi, body in _bodies(data, starts, ends):
        hashes, at = _words(body[0])
        train = trained[np.searchsorted(body[1], at, "right") + lo]
        part = [np.unique(hashes[train], return_counts=True), (np.unique(hashes[~train]), np.int64(0))]
        words += [(k, np.broadcast_to(n, len(k))) for k, n in part]
        if sum(len(g[0]) for g in words) > 1 << 21:
            words = [_add(words)]
    return _add(grams), _add(words)


def _bodies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(first text, text after the last, (bytes of the texts without the line feeds before them, their ends)), some MB at a time.

    A text is never cut here: the hashes of its words need them whole.
    """
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART, "right")))
        yield i, j, (np.concatenate([data[s:e] for s, e in zip(starts[i:j], ends[i:j], strict=True)]), np.cumsum(ends[i:j] - starts[i:j]))
        i = j


class _Lookup:
    """Places of keys among sorted distinct keys that hold them: by a hash table, by bisection where two keys meet in a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, (4 * max(1, len(keys))).bit_length()))
        self.table = np.zeros(1 << int(64 - int(self.shift)), np.int32)
        self.table[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def at(self, keys: np.ndarray) -> np.ndarray:
        i = self.table[self.slot(keys)]
        off = np.flatnonzero(self.keys[i] != keys)
        i[off] = np.searchsorted(self.keys, keys[off])
        return i


def _score(data, lengths, depth, grams: _Lookup, logs: np.ndarray, words: _Lookup, counts: np.ndarray, total: int, kinds: int):
    """n_tokens, n_known, base_score, score of the texts of a chunk."""
    starts, ends = _texts_at(lengths, depth)
    score = np.zeros(len(lengths))
    for lo, hi in _parts(len(data), depth):
        doc = np.searchsorted(ends, np.arange(lo, hi), "right")
        inside = np.arange(lo, hi) >= starts[doc]
        first = int(doc[0])
        v = logs[grams.at(gram_keys(data[lo - depth : hi], depth)[inside])]
        part = np.bincount(doc[inside] - first, weights=v)
        score[first : first + len(part)] += part
    tokens, known, base = [], [], []
    for _, _, (body, upto) in _bodies(data, starts, ends):
        hashes, at = _words(body)
        doc = np.searchsorted(upto, at, "right")
        c = counts[words.at(hashes)]
        v = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
        tokens.append(np.bincount(doc, minlength=len(upto)))
        known.append(np.bincount(doc[c > 0], minlength=len(upto)))
        base.append(np.bincount(doc, weights=v, minlength=len(upto)))
    return np.concatenate(tokens), np.concatenate(known), np.concatenate(base), score


# --- the jobs -------------------------------------------------------------------------------------------


def _chunks(docs: DataFrame, depth: int, chunk_bytes: int, id_type: str, id_arrow) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        task, seq, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def chunk():
            data = b"".join(b"\n" * depth + t for _, t in held)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | seq], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([[o for o, _ in held]], pa.list_(pa.bool_())), pa.array([[len(t) for _, t in held]], pa.list_(pa.int64())), pa.array([len(data)], pa.int64()), pa.array([_pack(np.frombuffer(data, np.uint8))], pa.binary())],
                names=["chunk", "ids", "held", "lengths", "size", "data"],
            )

        for b in batches:
            for key, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = normal(text.as_py())
                if held and size + len(t) + depth > chunk_bytes:
                    yield chunk()
                    ids, held, size, seq = [], [], 0, seq + 1
                ids.append(key)
                held.append((out, t))
                size += len(t) + depth
        if held:
            yield chunk()

    return docs.mapInArrow(run, f"chunk long, ids array<{id_type}>, held array<boolean>, lengths array<long>, size long, data binary")


ASKED = "kind int, slab int, chunk long, m long, keys binary, vals binary"


def _row(kind, slab, chunk, keys, vals: np.ndarray):
    return kind, slab, chunk, len(keys), _pack_keys(keys), _pack(vals)


def _batch(rows) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=[f.split()[0] for f in ASKED.split(", ")])


def _asks(chunks: DataFrame, depth: int, slabs: int) -> DataFrame:
    """What every chunk needs, cut by slab."""

    def run(batches):
        for b in batches:
            for chunk, held, lengths, size, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "held", "lengths", "size", "data")), strict=True):
                both = _gather(_unpack(data, size, np.uint8), np.array(lengths, np.int64), ~np.array(held, bool), depth)
                for kind, (keys, n) in enumerate(both):
                    slab = (mix64(keys >> np.uint64(8 * (depth - UNIT) + 8) if kind == GRAMS else keys) % np.uint64(slabs)).astype(np.int32)
                    order = np.argsort(slab, kind="stable")
                    cut = np.flatnonzero(np.concatenate(([True], slab[order][1:] != slab[order][:-1], [True]))) if len(slab) else [0]
                    yield _batch([_row(kind, int(slab[order[lo]]), chunk, keys[order[lo:hi]], n[order[lo:hi]].astype(np.int64)) for lo, hi in zip(cut[:-1], cut[1:], strict=True)])

    return chunks.select("chunk", "held", "lengths", "size", "data").mapInArrow(run, ASKED)


def _totals(asked: DataFrame) -> DataFrame:
    """One row a slab: its distinct keys with the sums of all chunks, read in a stream."""

    def run(batches):
        key, held, size = None, [], 0

        def slab():
            keys, n = _add(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((*key, len(keys), _pack_keys(keys), _pack(n), int(n.sum()), int((n > 0).sum())), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                names=["kind", "slab", "m", "keys", "vals", "total", "seen"],
            )

        for b in batches:
            for kind, s, _, m, keys, vals in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (kind, s) != key:
                    if held:
                        yield slab()
                    key, held, size = (kind, s), [], 0
                held.append((_unpack_keys(keys, m), _unpack(vals, m)))
                size += m
                if size > max(1 << 21, 2 * len(held[0][0])):
                    held = [_add(held)]
                    size = len(held[0][0])
        if held:
            yield slab()

    d = asked.repartition("kind", "slab").sortWithinPartitions("kind", "slab")
    return d.mapInArrow(run, "kind int, slab int, m long, keys binary, vals binary, total long, seen long")


def _top(totals: DataFrame, depth: int) -> Top:
    """The upper levels, from sums over the subtrees of each pair of bytes; bounded by the alphabet."""

    def run(batches):
        for b in batches:
            for m, keys, vals in zip(*(b.column(c).to_pylist() for c in ("m", "keys", "vals")), strict=True):
                k, n0, n1, w = Subtrees(_unpack_keys(keys, m), _unpack(vals, m), depth).roots()
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64)), pa.array(w)], names=["node", "n0", "n1", "w"])

    rows = totals.where(F.col("kind") == GRAMS).select("m", "keys", "vals").mapInArrow(run, "node long, n0 long, n1 long, w double")
    t = rows.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).toArrow()
    return Top(*(t.column(c).to_numpy().astype(k) for c, k in (("node", np.uint64), ("n0", np.int64), ("n1", np.int64), ("w", float))))


def _answers(asked: DataFrame, totals: DataFrame, top, depth: int) -> DataFrame:
    """For every chunk and slab what it asked for: log10 of the grams, counts of the words."""

    def run(batches):
        keys = values = None
        for b in batches:
            out = []
            for kind, slab, chunk, m, k, v in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if chunk is None:
                    keys, values = _unpack_keys(k, m), _unpack(v, m)
                    if kind == GRAMS:
                        values = Subtrees(keys, values, depth).log10(top.value).view(np.int64)
                else:
                    mine = _unpack_keys(k, m)
                    out.append(_row(kind, slab, chunk, mine, values[np.searchsorted(keys, mine)]))
            yield _batch(out)

    slabs = totals.select("kind", "slab", F.lit(None).cast("long").alias("chunk"), "m", "keys", "vals")
    asks = asked.select("kind", "slab", "chunk", "m", "keys", F.lit(b"").alias("vals"))
    d = slabs.unionByName(asks).repartition("kind", "slab").sortWithinPartitions("kind", "slab", F.col("chunk").asc_nulls_first())
    return d.mapInArrow(run, ASKED)


def score_documents(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.

    Texts whose crc32(id as text) is divisible by 10 are held out, the others train. base_score is log10 of the tokens
    under unigram counts with 0.1 added, score log10 under the context tree, bits_per_byte its code length.
    """
    spark = docs.sparkSession
    if not UNIT <= depth <= 7:
        raise ValueError(f"depth must be {UNIT} to 7")
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    d = docs.select(F.col(id_col).alias("doc_id"), out.alias("held"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    chunks = materialize(_chunks(d, depth, chunk_bytes, id_type.simpleString(), id_arrow), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    slabs = int(min(MOST_SLABS, max(8, -(-size // SLAB_BYTES))))
    asked = materialize(_asks(chunks, depth, slabs), "asked")
    totals = materialize(_totals(asked), "totals")
    n, v = totals.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("seen")).first()
    total, kinds = n or 0, v or 0
    top = spark.sparkContext.broadcast(_top(totals, depth))
    answers = materialize(_answers(asked, totals, top, depth), "answers")
    remove(spark, asked)
    remove(spark, totals)

    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")

    def run(batches):
        key, held = None, ([], [])
        for b in batches:
            for chunk, kind, m, keys, vals, ids, out, lengths, size, data in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if chunk != key:
                    key, held = chunk, ([], [])
                if data is None:
                    held[kind].append((_unpack_keys(keys, m), _unpack(vals, m)))
                    continue
                found = []
                for h in held:
                    k, x = (np.concatenate(p) for p in zip(*h, strict=True))
                    order = np.argsort(k)
                    found += [_Lookup(k[order]), x[order]]
                found[1] = found[1].view(float)
                lengths = np.array(lengths, np.int64)
                tokens, known, base, score = _score(_unpack(data, size, np.uint8), lengths, depth, *found, total, kinds)
                held = ([], [])
                bits = score * -math.log2(10) / lengths
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(out, pa.bool_()), *(pa.array(x) for x in (tokens, known, np.full(len(ids), total), base, score, lengths, bits))], names=names)

    told = answers.select("chunk", "kind", "m", "keys", "vals", *(F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in ("ids", "held", "lengths", "size", "data")))
    asks = chunks.select("chunk", *(F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in ("kind", "m", "keys", "vals")), "ids", "held", "lengths", "size", "data")
    both = told.unionByName(asks).repartition("chunk").sortWithinPartitions("chunk", F.col("kind").asc_nulls_last())
    result = both.mapInArrow(run, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
    scored = materialize(result, "scored")
    remove(spark, answers)
    remove(spark, chunks)
    return scored
