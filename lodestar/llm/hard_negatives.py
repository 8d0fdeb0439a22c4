"""Hard negatives by a Voronoi-partition distributed kNN join.

Every vector gets one more component, the root of M^2 - |x|^2 (M: the largest norm), and an anchor a zero,
so that the nearest vectors of an anchor are those of the largest inner product. Vectors are assigned to the
nearest of at most ``PIVOTS`` pivots (rows of the table, chosen by a hash) and kept in slices, each of
one cell and ordered by the distance from its pivot. Anchors of neighbouring cells form about ``GROUPS``
groups at most, whatever their number. What an anchor searches is a ring: scores of a known range are distances of a known range, and the
scores of the pivots bound the range from the start. By the triangle inequality the ring of an anchor reaches
a range of distances from each pivot; the hull of these ranges over a group (some GROUPS * PIVOTS
pairs of numbers) tells which vectors of a cell might serve the group, and only these are sent to it. A group is
cut into blocks of anchors, and what is sent to it is dealt over several keys; an exact join of block and slice
follows and keeps, for every anchor, the first few of each range of scores. A last window merges these.

Positives are the search of the scores from the fifth best probe of the anchor's label up, hard negatives that of
the ranges that the positives' scores give. Of rows with equal label and equal vector only the first six ids can
ever be returned, so a slice leaves the others out: hot vectors do not move.

Pruning depends on the data: clustered vectors reach few groups, vectors without structure all of them, and
then every vector is sent about GROUPS times at most. The join itself is that of the stated anchors with all rows.

Components are integers after scaling; products are sums in doubles while they stay below 2^53, where these are
exact, else in 64-bit integers.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part,
nor do vectors whose length is not the most common one (of several, the greatest) or whose scaled norm reaches 2^31,
whose products a long cannot hold. Of several rows with an anchor's id, the one with the least label, then vector, is
the anchor, and none of them is its candidate; other rows with equal ids are separate candidates.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remove

PIVOTS, PROBES, GROUPS, GROUP_ROWS = 256, 2048, 64, 256
POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: Rows of a chunk that is cut into slices, of a slice, and anchors of a block.
CHUNK, SLICE, BLOCK = 65536, 256, 256
NONE = np.iinfo(np.int64).min
_TOP = np.iinfo(np.int64).max


def _vectors(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integer vectors as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    picked = column.filter(pa.array(ok))
    flat = picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    x = np.floor(SCALE * flat.reshape(len(picked), dim))
    with np.errstate(over="ignore", invalid="ignore"):
        fine = np.isfinite(x).all(1) & ((x * x).sum(1) < 2.0**62)
    ok[np.flatnonzero(ok)[~fine]] = False
    return ok, x[fine]


def _valid(rows: DataFrame, id_col: str, label_col: str, vec_col: str, relabel: bool) -> DataFrame:
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label) if relabel else label
    d = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())


class Cells:
    """Different rows of the table (probes: integer vectors, ids, labels), of which the first ``n`` are the pivots; M^2."""

    def __init__(self, probes: np.ndarray, ids: np.ndarray, labels: np.ndarray, n: int, top2: float):
        self.probes, self.ids, self.labels, self.top2 = probes, ids, labels, top2
        self.pivots = pivots = probes[:n]
        self.norm2 = (pivots * pivots).sum(1)
        self.extra = np.sqrt(np.maximum(0.0, top2 - self.norm2))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Of augmented vectors from all augmented pivots."""
        n2 = (x * x).sum(1)[:, None]
        extra = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0.0, self.top2 - n2))
        return np.sqrt(np.maximum(0.0, n2 + self.norm2 - 2 * (x @ self.pivots.T) + (extra - self.extra) ** 2))

    def order(self) -> list[int]:
        """The cells as a chain in which the next one is the nearest that is left."""
        d = self.distances(self.pivots, False)
        left, chain = set(range(1, len(d))), [0]
        while left:
            chain.append(min(left, key=lambda j: d[chain[-1], j]))
            left.remove(chain[-1])
        return chain


def _cells(d: DataFrame) -> tuple[int, Cells | None]:
    """Length of the vectors, and the pivots: two counts over the table and a pass for at most PROBES rows."""
    size = F.size("v")
    common = d.where(size > 0).groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return 0, None
    dim, n = common["dim"], common["count"]

    def norms(batches):
        for b in batches:
            _, x = _vectors(b.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(1).max())] if len(x) else [], pa.float64())], names=["top2"])

    top2 = d.select("v").mapInArrow(norms, "top2 double").agg(F.max("top2")).first()[0]
    if top2 is None:
        return dim, None
    want = int(min(PIVOTS, max(16, n**0.5 // 2)))
    rows = d.where(size == dim).orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("v")).limit(PROBES).collect()
    ok, x = _vectors(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim)
    ids, labels = (np.array([r[f] for r in rows], np.int64)[ok] for f in ("id", "label"))
    if not len(x):  # no probe takes part: one cell around the origin
        return dim, Cells(np.zeros((1, dim)), np.array([NONE]), np.array([NONE]), 1, top2)
    first = np.sort(np.unique(np.column_stack((x, labels)), axis=0, return_index=True)[1])
    return dim, Cells(x[first], ids[first], labels[first], want, top2)


SLICES = "cell int, near double, far double, dist binary, ids binary, labels binary, vecs binary"


def _slices(d: DataFrame, cells, dim: int, same: int) -> DataFrame:
    """All rows in slices of one cell, ordered by distance; of equal label and vector the first ``same`` ids."""

    def cut(ids, labels, x, c):
        order = np.lexsort((ids, labels))
        whole = np.ascontiguousarray(np.column_stack((labels[order].astype(np.int64), x[order].astype(np.int64))))
        kind = np.unique(whole.view(f"V{whole.shape[1] * 8}").ravel(), return_inverse=True)[1]
        by = np.argsort(kind, kind="stable")  # ids ascend within a kind
        at = np.flatnonzero(np.concatenate(([True], kind[by][1:] != kind[by][:-1])))
        rank = np.arange(len(by)) - np.repeat(at, np.diff(np.append(at, len(by))))
        keep = order[by[rank < same]]
        ids, labels, x = ids[keep], labels[keep], x[keep]
        dist = c.distances(x, False)
        cell = dist.argmin(1)
        dist = dist[np.arange(len(x)), cell]
        order = np.lexsort((ids, dist, cell))
        starts = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1])))
        for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
            for a in range(lo, hi, SLICE):
                i = order[a : min(hi, a + SLICE)]
                yield int(cell[i[0]]), float(dist[i[0]]), float(dist[i[-1]]), dist[i].tobytes(), ids[i].tobytes(), labels[i].tobytes(), x[i].astype("<i4").tobytes()

    def run(batches):
        c, held, size = cells.value, [], 0
        for b in batches:
            ok, x = _vectors(b.column(2), dim)
            held.append((b.column(0).to_numpy(zero_copy_only=False)[ok], b.column(1).to_numpy(zero_copy_only=False)[ok], x))
            size += len(x)
            if size >= CHUNK:
                yield from _batches(cut(*map(np.concatenate, zip(*held, strict=True)), c), SLICES)
                held, size = [], 0
        if size:
            yield from _batches(cut(*map(np.concatenate, zip(*held, strict=True)), c), SLICES)

    return d.mapInArrow(run, SLICES)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batches(rows, schema: str, most: int = 256):
    fields = [f.split() for f in schema.split(", ")]
    names, types, held = [f[0] for f in fields], [_ARROW[f[1]] for f in fields], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for r in rows:
        held.append(r)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


ANCHORS = "id long, label long, vec binary, home int, low binary, high binary"


def _anchors(d: DataFrame, cells, dim: int, every: int) -> DataFrame:
    """The anchors with their home cell and the range of scores that their positives have."""

    def run(batches):
        c = cells.value
        for b in batches:
            ok, x = _vectors(b.column(2), dim)
            if not len(x):
                continue
            ids, labels = (b.column(i).to_numpy(zero_copy_only=False)[ok] for i in (0, 1))
            home = c.distances(x, True).argmin(1)
            # The fifth best other probe of the label bounds the fifth positive from below.
            other = (c.labels[None, :] == labels[:, None]) & (c.ids[None, :] != ids[:, None])
            low = _last(np.where(other, _products(x, c.probes), NONE), POSITIVES)
            yield from _batches(zip(ids.tolist(), labels.tolist(), [v.tobytes() for v in x.astype("<i4")], home.tolist(), [v.tobytes() for v in low], [np.int64(_TOP).tobytes()] * len(x), strict=True), ANCHORS)

    d = d.where((F.col("id") % every == 0) & (F.size("v") == dim))
    one = F.row_number().over(Window.partitionBy("id").orderBy("label", "vec"))
    return d.mapInArrow(run, ANCHORS).withColumn("k", one).where("k = 1").drop("k")


def _last(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, NONE in rows of fewer."""
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), NONE)


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, in the cheapest type that holds them."""
    if not len(a) or not len(x):
        return np.zeros((len(a), len(x)), np.int64)
    most = np.sqrt((a.astype(float) ** 2).sum(1).max() * (x.astype(float) ** 2).sum(1).max())
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    return (a.astype(kind) @ x.T.astype(kind)).astype(np.int64)


def _spread(counts: dict[int, int], chain: list[int]) -> dict[int, int]:
    """Cell -> group: neighbours in the chain share a group of about GROUP_ROWS anchors, and more where GROUPS would be exceeded."""
    most = max(GROUP_ROWS, -(-sum(counts.values()) // GROUPS))
    out, group, size = {}, 0, 0
    for cell in chain:
        if size and size + counts.get(cell, 0) > 2 * most or size >= most:
            group, size = group + 1, 0
        out[cell] = group
        size += counts.get(cell, 0)
    return out


def _reach(x: np.ndarray, low: np.ndarray, high: np.ndarray, c: Cells) -> tuple[np.ndarray, np.ndarray]:
    """For anchors and cells the range of distances from the pivot in which the anchor's scores lie."""
    d = c.distances(x, True)
    a2 = (x * x).sum(1) + c.top2
    slack = 1e-6 * (1 + a2)
    far = np.sqrt(np.maximum(0.0, a2 - 2 * low.astype(float) + slack))[:, None]
    near = np.sqrt(np.maximum(0.0, a2 - 2 * high.astype(float) - slack))[:, None]
    slack = 1e-6 * (1 + np.sqrt(a2))[:, None]
    return np.maximum(d - far, near - d) - slack, d + far + slack


def _search(anchors: DataFrame, slices: DataFrame, cells, dim: int, same_label: bool, k: int) -> DataFrame:
    """(id, which, cand, score, rank): of each of an anchor's ranges of scores the first k rows of its label, or of others."""
    spark = anchors.sparkSession
    counts = {r["home"]: r["count"] for r in anchors.groupBy("home").count().collect()}  # a row per cell
    group = _spread(counts, cells.value.order())
    n_groups = max(group.values()) + 1
    n_cells = len(cells.value.pivots)

    def arrays(b):
        x = np.frombuffer(b"".join(b.column("vec").to_pylist()), "<i4").reshape(-1, dim)
        low, high = (np.frombuffer(b"".join(b.column(f).to_pylist()), np.int64).reshape(len(x), -1) for f in ("low", "high"))
        return b.column("id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False), x, low, high

    def hulls(batches):
        c = cells.value
        lows, highs = np.full((n_groups, n_cells), np.inf), np.full((n_groups, n_cells), -np.inf)
        for b in batches:
            _, _, x, low, high = arrays(b)
            lo, hi = _reach(x.astype(float), low.min(1), high.max(1), c)
            g = np.array([group[h] for h in b.column("home").to_pylist()])
            np.minimum.at(lows, g, lo)
            np.maximum.at(highs, g, hi)
        seen = np.argwhere(highs > -np.inf)
        yield from _batches(((int(i), int(j), float(lows[i, j]), float(highs[i, j])) for i, j in seen), "grp int, cell int, low double, high double")

    partial = anchors.mapInArrow(hulls, "grp int, cell int, low double, high double")
    routes: dict[int, list] = {}
    for r in partial.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("grp", "cell").collect():  # about GROUPS * PIVOTS at most
        routes.setdefault(r["cell"], []).append((r["grp"], r["low"], r["high"]))
    routes_ = spark.sparkContext.broadcast(routes)
    deal = int(max(1, min(64, -(-2 * spark.sparkContext.defaultParallelism // n_groups))))

    def send(batches):
        for b in batches:
            out = []
            for cell, near, far, dist, ids, labels, vecs in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                d = np.frombuffer(dist, float)
                for g, low, high in routes_.value.get(cell, ()):
                    if low <= far and high >= near:
                        i, j = int(np.searchsorted(d, low)), int(np.searchsorted(d, high, "right"))
                        if i < j:
                            out.append((g, zlib.crc32(ids[:8]) % deal, ids[8 * i : 8 * j], labels[8 * i : 8 * j], vecs[4 * dim * i : 4 * dim * j]))
            yield from _batches(out, "grp int, part int, ids binary, labels binary, vecs binary")

    def blocks(batches):
        held: dict[int, list] = {}

        def block(g):
            ids, labels, x, low, high = (np.concatenate(p) for p in zip(*held.pop(g), strict=True))
            for i in range(0, len(ids), BLOCK):
                s = slice(i, i + BLOCK)
                yield g, ids[s].tobytes(), labels[s].tobytes(), x[s].tobytes(), low[s].tobytes(), high[s].tobytes()

        schema = "grp int, a_ids binary, a_labels binary, a_vecs binary, low binary, high binary"
        for b in batches:
            part = arrays(b)
            g = np.array([group[h] for h in b.column("home").to_pylist()])
            for v in np.unique(g).tolist():
                held.setdefault(v, []).append(tuple(p[g == v] for p in part))
                if sum(len(p[0]) for p in held[v]) >= BLOCK:
                    yield from _batches(block(v), schema)
        for v in list(held):
            yield from _batches(block(v), schema)

    served = slices.mapInArrow(send, "grp int, part int, ids binary, labels binary, vecs binary")
    asked = anchors.mapInArrow(blocks, "grp int, a_ids binary, a_labels binary, a_vecs binary, low binary, high binary")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))

    def join(batches):
        """Keeps the best of a block until another key comes."""
        best: dict[bytes, _Best] = {}
        key = None
        for b in batches:
            for g, part, a_ids, a_labels, a_vecs, low, high, ids, labels, vecs in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if (g, part) != key:
                    for x in best.values():
                        yield from x.rows()
                    best, key = {}, (g, part)
                if a_ids not in best:
                    n = len(a_ids) // 8
                    best[a_ids] = _Best(*(np.frombuffer(v, np.int64) for v in (a_ids, a_labels)), np.frombuffer(a_vecs, "<i4").reshape(n, dim), *(np.frombuffer(v, np.int64).reshape(n, -1) for v in (low, high)), same_label, k)
                best[a_ids].meet(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vecs, "<i4").reshape(-1, dim))
        for x in best.values():
            yield from x.rows()

    pairs = asked.hint("merge").join(served, ["grp", "part"]).select("grp", "part", "a_ids", "a_labels", "a_vecs", "low", "high", "ids", "labels", "vecs")
    found = pairs.mapInArrow(join, "id long, which int, cand long, score long")
    rank = F.row_number().over(Window.partitionBy("id", "which").orderBy(F.desc("score"), "cand"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class _Best:
    """The first k candidates of every anchor of a block in each of its ranges of scores."""

    def __init__(self, ids, labels, x, low, high, same_label, k):
        self.ids, self.labels, self.x, self.same, self.k = ids, labels, x, same_label, k
        self.high = high
        self.least = low.copy()  # a candidate below cannot enter; one that equals it only by a lower id than last
        self.last = np.full(low.shape, _TOP)
        self.held = [(np.zeros(0, np.int64),) * 3 for _ in range(low.shape[1])]  # (anchor, score, id) of each range

    def meet(self, ids, labels, vecs):
        s = _products(self.x, vecs)
        fit = (self.labels[:, None] == labels[None, :]) == self.same
        fit &= self.ids[:, None] != ids[None, :]
        for j in range(self.high.shape[1]):
            least = self.least[:, j][:, None]
            hit = fit & (s >= least) & (s <= self.high[:, j][:, None])
            r, c = np.nonzero(hit)
            tie = (s[r, c] == self.least[r, j]) & (ids[c] > self.last[r, j])
            r, c = r[~tie], c[~tie]
            if len(r):
                a, score, cand = (np.concatenate(p) for p in zip(self.held[j], (r, s[r, c], ids[c]), strict=True))
                order = np.lexsort((cand, -score, a))
                a, score, cand = a[order], score[order], cand[order]
                first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
                keep = rank < self.k
                self.held[j] = a[keep], score[keep], cand[keep]
                full = np.flatnonzero(rank == self.k - 1)
                self.least[a[full], j], self.last[a[full], j] = score[full], cand[full]

    def rows(self):
        for j, (a, score, cand) in enumerate(self.held):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(np.full(len(a), j, np.int32)), pa.array(cand), pa.array(score)], names=["id", "which", "cand", "score"])


def hard_negatives(rows: DataFrame, every: int = 50, relabel: bool = False, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; their positives the first 5 other rows of the label by score,
    then id; the negatives of each the first 3 rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    ``relabel`` first moves the label of ids that 7 divides to (label + 1) % 10.
    """
    spark = rows.sparkSession
    d = _valid(rows, id_col, label_col, vec_col, relabel)
    dim, found = _cells(d)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if found is None:
        return spark.createDataFrame([], schema)
    cells = spark.sparkContext.broadcast(found)
    slices = materialize(_slices(d, cells, dim, POSITIVES + 1), "slices")
    anchors = materialize(_anchors(d, cells, dim, every), "anchors")
    positives = materialize(_search(anchors, slices, cells, dim, True, POSITIVES), "positives")

    # The ranges of scores that the positives allow, in the order of rank; a range without scores ends below its beginning.
    windows = positives.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))  # at most 5

    def ranges(batches):
        c = cells.value
        for b in batches:
            out = []
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").reshape(-1, dim)
            for row, key, label, vec, home, p in zip(_products(x, c.probes), *(b.column(i).to_pylist() for i in range(5)), strict=True):
                scores = [x["score"] for x in p]
                lows = np.array([-(-low * s // 100) for s in scores] + [1] * (POSITIVES - len(p)), np.int64)
                highs = np.array([high * s // 100 for s in scores] + [0] * (POSITIVES - len(p)), np.int64)
                # The third best probe of another label in a range bounds the third negative from below.
                probes = np.where((c.labels != label) & (c.ids != key), row, NONE)
                lows = np.maximum(lows, _last(np.where(probes <= highs[:, None], probes, NONE), NEGATIVES))
                if (lows <= highs).any():
                    some = lows <= highs  # the others take the range of nothing inside the hull of these
                    at, to = lows[some].min(), highs[some].max()
                    out.append((key, label, vec, home, np.where(some, lows, to).tobytes(), np.where(some, highs, at - 1).tobytes()))
            yield from _batches(out, ANCHORS)

    asked = anchors.join(windows, "id").select("id", "label", "vec", "home", "p").mapInArrow(ranges, ANCHORS)
    asked = materialize(asked, "windows")
    negatives = _search(asked, slices, cells, dim, False, NEGATIVES)
    p = positives.select(F.col("id").alias("anchor_id"), (F.col("rank") - 1).alias("which"), F.col("cand").alias("positive_id"), F.col("score").alias("positive_score"))
    n = negatives.select(F.col("id").alias("anchor_id"), "which", "rank", F.col("cand").alias("negative_id"), F.col("score").alias("negative_score"))
    out = materialize(p.join(n, ["anchor_id", "which"]).select(*(f.split()[0] for f in schema.split(", "))), "negatives")
    for x in (slices, anchors, positives, asked):
        remove(spark, x)
    return out
