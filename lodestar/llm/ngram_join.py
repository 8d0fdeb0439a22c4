"""Near-duplicate join on word n-grams with Bayesian pruning of candidates.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is at
least 0.8. The steps:

1. Documents with equal shingle sets form a class, by a 128-bit digest and map-side combine: a group
   of copies is one class however large. Only classes go on.
2. ``BANDS`` keys of ``ROWS`` MinHash values each; a key shared by several classes makes a bucket. Each
   bucket compares its members with one of them by their sketches (a star, not all pairs; the choice
   differs between keys). Members that may reach similarity ``LOOSE`` with the centre are linked to it;
   a bucket whose members are all linked to one centre is done. In others the members that surely
   reach ``LOOSE`` + 1 - threshold are done, and the rest go on to a next turn with four times as many centres. No
   pair gets lost: shingle distance is a metric, so whatever is near a member that is done is itself linked to the same centre.
3. Connected components of the star edges are the regions inside which links can lie. A region is a group, or
   its buckets are, whichever sends fewer rows: buckets where few classes of a region share keys, as texts around one
   passage that are else unlike, the region where most do, as copies. Of buckets, only that of the first key which a pair
   shares compares it. A group is cut into blocks of bounded size; every pair of blocks is one task unit.
4. A unit gets stored sketches alone. MinHash values are compared a few at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold falls below ``TOLERANCE`` (uniform
   prior). Only classes that keep a partner in the unit send their text there, and the pairs that are left
   are verified on the whole shingle sets. A unit returns each class's number of links and a
   spanning forest of them, never its pairs.
5. Components of the forests give the groups.

A pair at exactly 0.8 shares no bucket with probability (1 - 0.8**8)**64, about 8e-6; one at 0.85, 5e-9. Each of the
comparisons of sketches errs with probability ``TOLERANCE`` at most. Shingles are 64-bit hashes of their words: two
different ones of a pair agree with probability 5e-20 times the product of their numbers. A bucket whose
members are alike to no centre costs a share of its pairs; that takes eight equal MinHash values of texts that are unlike.

Defined results: a text of one to four words has one shingle, all its words; a null text or one
without words has no shingle, no link and is its own group; a null id has no group; rows that
repeat an id are one document, linked by any of its texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, remove, texts, word_hashes
from .graph import components

WORDS, ROWS, BANDS = 5, 8, 64
HASHES = ROWS * BANDS
STEP = 32  # MinHash values that are compared at a time
TOLERANCE, LOOSE, LOOSE_HASHES = 1e-6, 0.4, 256
BLOCK = 128
UNIT_ROWS = 4096  # of a task of units, on average
_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_COEF = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = [int(x) for x in _RNG.integers(0, 2**62, 8)]


def shingle_sets(batch: list[str], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    h, at = word_hashes(batch)
    k = len(h) - n + 1
    if k > 0:
        grams = np.zeros(k, np.uint64)
        for i in range(n):
            grams += h[i : i + k] * _COEF[i]
        grams = mix64(grams)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            m = hi - lo
            out.append(mix64(np.array([(h[lo:hi] * _COEF[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES MinHash values (uint32) of each set; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    i = 0
    while i < len(sets):  # groups whose values fit into the CPU's cache
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 24_000):
            total += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        x = (flat ^ flat >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        buf = np.empty_like(x)
        for k in range(HASHES):
            np.bitwise_xor(x, _XOR[k], out=buf)
            np.multiply(buf, _MUL[k], out=buf)
            out[i:j, k] = np.minimum.reduceat(buf, starts)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    m = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * _COEF[r] + m[:, :, r])
    return key.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n one-byte MinHash values that leave P(similarity >= threshold) at tolerance or above."""
    p = (np.arange(20_000) + 0.5) / 20_000
    t = threshold + (1 - threshold) / 256  # bytes also agree by chance
    for m in range(n + 1):
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        density = np.exp(log - log.max())
        if density[p >= t].sum() >= tolerance * density.sum():
            return m
    return n


_LEAST: dict[tuple[int, float, float], int] = {}


def bar(n: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    key = n, threshold, tolerance
    if key not in _LEAST:
        _LEAST[key] = least_matches(n, threshold, tolerance)
    return _LEAST[key]


def _chunks(columns: list[pa.Array], batch: list[str], most: int = 1 << 20):
    """Parts of a batch of about ``most`` characters."""
    lo = size = 0
    for i, t in enumerate(batch):
        size += len(t)
        if size >= most or i == len(batch) - 1:
            yield [c.slice(lo, i + 1 - lo) for c in columns], batch[lo : i + 1]
            lo, size = i + 1, 0


def sketches(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text), digest (null without shingles), shingles, sketch (a byte of each MinHash value), keys (one per band)."""

    def run(batches):
        for b in batches:
            for (ids, ties), part in _chunks([b.column(0), b.column(1)], b.column(2).to_pylist()):
                sets = shingle_sets(part, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, sketch, keys = [None] * len(part), [None] * len(part), [None] * len(part)
                if full:
                    sig = minhashes([sets[i] for i in full])
                    band = band_keys(sig)
                    low = (sig & np.uint32(255)).astype(np.uint8)
                    for k, i in enumerate(full):
                        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        sketch[i], keys[i] = low[k].tobytes(), band[k]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, ties, pa.array(digest, pa.binary()), sizes, pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tie", "digest", "shingles", "sketch", "keys"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return d.mapInArrow(run, "doc_id long, tie long, digest binary, shingles long, sketch binary, keys array<long>")


def star_edges(reps: DataFrame, threshold: float = 0.8, loose: float = LOOSE) -> DataFrame:
    """Edges (a, b) between classes such that any two classes that share a key and reach the threshold are in one component.

    reps: class_id, sketch, keys. Say x and y reach the threshold, and x is done with centre c: the
    similarity of x and c is ``loose`` + 1 - threshold or more, so by the triangle inequality that of
    y and c is ``loose`` or more, and both are linked to c. Until then both stay in the bucket.
    """
    spark = reps.sparkSession
    rows = reps.select(F.explode("keys").alias("key"), "class_id")
    small = reps.select("class_id", F.substring("sketch", 1, LOOSE_HASHES).alias("sketch"))
    least, sure = bar(LOOSE_HASHES, loose), bar(LOOSE_HASHES, loose + 1 - threshold, 1 - TOLERANCE)

    @F.pandas_udf("int")
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, LOOSE_HASHES)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, LOOSE_HASHES)
        return pd.Series((x == y).sum(1).astype(np.int32))

    found, turn = [], 0
    while True:
        # The centres of a bucket: in each of 4**turn parts the least id after flipping bits by a mask that depends on key and turn.
        mask = F.element_at(F.array(*[F.lit(m) for m in _MASKS]), (F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(8)) + 1).cast("int"))
        part = F.pmod(F.xxhash64("class_id", F.lit(turn)), F.lit(4**turn))
        flipped = rows.withColumn("flipped", F.col("class_id").bitwiseXOR(mask))
        centres = flipped.groupBy("key", part.alias("part")).agg(F.min("flipped").alias("centre"))
        if turn == 0:
            buckets = flipped.groupBy("key").agg(F.count("*").alias("n"), F.min("flipped").alias("centre")).where("n > 1").select("key", "centre")
        else:
            buckets = centres.select("key", "centre")
        stars = flipped.join(buckets, "key").withColumn("centre", F.col("centre").bitwiseXOR(mask)).select("key", "class_id", "centre")
        stars = materialize(stars, "stars")
        edges = stars.where("centre <> class_id").select("class_id", "centre").distinct()
        two = edges.join(small, "class_id").join(small.select(F.col("class_id").alias("centre"), F.col("sketch").alias("other")), "centre")
        judged = materialize(two.select("class_id", "centre", matches("sketch", "other").alias("m")), "edges")
        found.append(judged.where(F.col("m") >= least).select(F.col("class_id").alias("a"), F.col("centre").alias("b")))
        all_texts = judged.groupBy("class_id", "centre").agg(F.min("m").alias("m"))  # of an id that has several
        # Buckets with a member that is not linked to a centre; mostly there are few.
        unlinked = all_texts.where(F.col("m") < least).select("class_id", "centre")
        keys = materialize(stars.join(unlinked, ["class_id", "centre"], "left_semi").select("key").distinct(), "open-keys")
        if keys.isEmpty():
            break
        still = stars.join(keys, "key", "left_semi").distinct()
        seen = materialize(still.join(all_texts, ["class_id", "centre"], "left").select("key", "class_id", "centre", F.coalesce("m", F.lit(LOOSE_HASHES)).alias("m")), "seen")
        remove(spark, stars)
        remove(spark, keys)
        # A bucket in which one centre is linked to all is one region already.
        over = seen.groupBy("key", "centre").agg(F.min("m").alias("m")).where(F.col("m") >= least).select("key").distinct()
        rest = seen.groupBy("key", "class_id").agg(F.max("m").alias("m")).where(F.col("m") < sure).select("key", "class_id").join(over, "key", "left_anti")
        rest = materialize(rest, "stars")
        remove(spark, seen)
        if turn:
            remove(spark, rows)
        rows, turn = rest, turn + 1
        if rows.groupBy("key").count().where("count > 1").isEmpty():
            break
    out = found[0]
    for e in found[1:]:
        out = out.unionByName(e)
    return out


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Unit:
    """The rows of one pair of blocks, in the order of their ids, and the pairs that their sketches leave open."""

    def __init__(self, rows: list[tuple], crossed: bool, threshold: float, band: int = -1):
        """rows: (class id, size, side, shingles, sketch, keys, ...); ``side`` tells the two blocks apart; ``band`` is that of a bucket's key."""
        rows.sort(key=lambda r: (r[2], r[0], r[4]))
        self.rows, self.threshold, self.band = rows, threshold, band
        self.ids = [r[0] for r in rows]
        self.length = np.array([r[3] for r in rows])
        self.sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        self.keys = np.array([r[5] for r in rows], np.int64) if band >= 0 else None
        self.split = sum(r[2] == rows[0][2] for r in rows) if crossed else None

    def open(self):
        """(i, partners j of a later row) by incremental comparison."""
        n, t, sketch, length = len(self.rows), self.threshold, self.sketch, self.length
        for i in range(n if self.split is None else self.split):
            j = np.arange(i + 1 if self.split is None else self.split, n)
            j = j[np.minimum(length[j], length[i]) >= t * np.maximum(length[j], length[i]) - 1e-9]
            if self.band >= 0 and len(j):
                shared = self.keys[j, : self.band + 1] == self.keys[i, : self.band + 1]
                j = j[shared[:, -1] & ~shared[:, :-1].any(1)]
            got = np.zeros(len(j), np.int32)
            for lo in range(0, HASHES, STEP):
                if not len(j):
                    break
                got += (sketch[j, lo : lo + STEP] == sketch[i, lo : lo + STEP]).sum(1)
                ok = got >= bar(lo + STEP, t)
                j, got = j[ok], got[ok]
            if len(j):
                yield i, j

    def survivors(self) -> list[int]:
        alive = np.zeros(len(self.rows), bool)
        for i, j in self.open():
            alive[i] = True
            alive[j] = True
        return np.flatnonzero(alive).tolist()

    def links(self, sets: list[np.ndarray]) -> tuple[dict[int, list[int]], _Forest]:
        """{class: [linked classes, linked documents]} and the forest, from the rows' shingle sets."""
        counts: dict[int, list[int]] = {}
        forest, ids, t = _Forest(), self.ids, self.threshold
        if len(sets) < 2:
            return counts, forest
        length = np.array([len(s) for s in sets])
        starts = np.concatenate(([0], np.cumsum(length)[:-1]))
        universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(len(universe), np.int32)
        for i, j in self.open():
            mine = flat[starts[i] : starts[i] + length[i]]
            flag[mine] = 1
            if len(j) > 8:
                common = np.add.reduceat(flag[flat], starts)[j]
            else:
                common = np.array([flag[flat[starts[x] : starts[x] + length[x]]].sum() for x in j])
            flag[mine] = 0
            for x, c in zip(j.tolist(), common.tolist(), strict=True):
                if c >= t * (int(length[i]) + int(length[x]) - c) - 1e-9 and ids[i] != ids[x]:
                    for p, q in ((i, x), (x, i)):
                        k = counts.setdefault(ids[p], [0, 0])
                        k[0] += 1
                        k[1] += self.rows[q][1]
                    forest.link(ids[i], ids[x])
        return counts, forest


UNIT = ["grp", "band", "lo", "hi"]


def _by_unit(columns: list[str], done):
    """A function for mapInArrow over rows sorted by UNIT; ``done(unit, rows)`` gives a unit's batch or None."""

    def run(batches):
        unit, held = None, []
        for batch in batches:
            for grp, band, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in [*UNIT, *columns]), strict=True):
                if unit != (grp, band, lo, hi):
                    if held and (out := done(unit, held)):
                        yield out
                    unit, held = (grp, band, lo, hi), []
                held.append(tuple(row))
        if held and (out := done(unit, held)):
            yield out

    return run


def _dealt(rows: DataFrame, count: int) -> DataFrame:
    """Rows by unit: tasks in proportion to their ``count``, so that none holds more than a few units beyond the mean."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // UNIT_ROWS)
    return rows.repartition(n, *UNIT).sortWithinPartitions(*UNIT)


def groups_of(reps: DataFrame, regions: DataFrame) -> DataFrame:
    """(class_id, size, grp, band, blocks, tie, shingles, sketch, keys): a class with every group that it is compared in.

    A region's own rows meet ``blocks`` units each. A region of several blocks gives way to its buckets
    if these send fewer rows; ``band`` is -1 and ``keys`` null for a region. Classes of different regions have no link, so a
    bucket is one of a region.
    """
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    width = regions.groupBy("region").agg(blocks, F.count("*").alias("n"))
    large = regions.join(width.where("blocks > 1").select("region"), "region", "left_semi")
    keyed = large.join(reps.select("class_id", "keys"), "class_id").select("region", "class_id", F.posexplode("keys").alias("band", "key")).distinct()
    bucket = materialize(keyed.groupBy("region", "band", "key").agg(blocks, F.count("*").alias("n")).where("n > 1"), "buckets")
    split = bucket.groupBy("region").agg(F.sum(F.col("n") * F.col("blocks")).alias("rows")).join(width, "region").where(F.col("rows") < F.col("n") * F.col("blocks")).select("region")
    # A large region without any shared key has no unit at all.
    split = materialize(split.unionByName(width.where("blocks > 1").select("region").join(bucket.select("region"), "region", "left_anti")), "split")
    whole = regions.join(width.drop("n"), "region").join(split, "region", "left_anti").select("class_id", "size", F.col("region").alias("grp"), F.lit(-1).alias("band"), "blocks")
    parts = keyed.join(split, "region", "left_semi").join(bucket.drop("n"), ["region", "band", "key"]).join(regions.select("class_id", "size"), "class_id")
    parts = parts.select("class_id", "size", F.xxhash64("region", "key").alias("grp"), "band", "blocks")
    return whole.unionByName(parts).join(reps.select("class_id", "tie", "shingles", "sketch", "keys"), "class_id").withColumn("keys", F.when(F.col("band") >= 0, F.col("keys")))


def unit_rows(placed: DataFrame) -> DataFrame:
    """The rows of the units: each class once for every block of its groups."""
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    spread = placed.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.select("grp", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "class_id", "size", "own", "shingles", "sketch", "keys", "tie")


def links(docs: DataFrame, reps: DataFrame, regions: DataFrame, threshold: float, n: int) -> DataFrame:
    """Rows (a, b, n_texts, n_docs): a forest edge where b is not null, else the counts of class a found in one unit.

    docs: doc_id, text; reps: class_id, tie, shingles, sketch, keys; regions: class_id, region, size.
    """
    spark = docs.sparkSession
    placed = materialize(groups_of(reps, regions), "placed")
    spread = unit_rows(placed)
    names = [*UNIT, "class_id", "size", "own", "shingles", "sketch", "keys", "tie"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def prune(unit, rows):
        u = Unit(rows, unit[2] != unit[3], threshold, unit[1])
        left = [(*unit, *u.rows[i]) for i in u.survivors()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left, strict=True), kinds, strict=True)], names=names) if left else None

    open_rows = _dealt(spread, spread.count()).mapInArrow(_by_unit(names[4:], prune), "grp long, band int, lo int, hi int, class_id long, size long, own int, shingles long, sketch binary, keys array<long>, tie long")
    open_rows = materialize(open_rows, "open")
    remove(spark, placed)

    def verify(unit, rows):
        u = Unit(rows, unit[2] != unit[3], threshold, unit[1])
        counts, forest = u.links(shingle_sets([r[-1] for r in u.rows], n))
        a, b, c, d = [], [], [], []
        for x, (texts_, docs_) in counts.items():
            a.append(x), b.append(None), c.append(texts_), d.append(docs_)
        for x in forest.up:
            if (r := forest.root(x)) != x:
                a.append(x), b.append(r), c.append(0), d.append(0)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, c, d)], names=["a", "b", "n_texts", "n_docs"])

    # One text of each class that has a partner left; rows that repeat an id and a text give it once.
    needed = materialize(open_rows.select("class_id", "tie").distinct(), "needed")
    text = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.xxhash64("text").alias("tie"), "text").join(needed, ["class_id", "tie"], "left_semi").dropDuplicates(["class_id", "tie"])
    text = materialize(text, "texts")
    rows = open_rows.join(text, ["class_id", "tie"]).select(*names[:-1], "text")
    found = materialize(_dealt(rows, open_rows.count()).mapInArrow(_by_unit([*names[4:-1], "text"], verify), "a long, b long, n_texts long, n_docs long"), "links")
    for x in (open_rows, needed, text):
        remove(spark, x)
    return found


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id of its group), copy_id (least id with equal shingles), n_links, n_linked_docs.

    n_links counts the different shingle sets that are linked to the document's, n_linked_docs the
    documents that have them and its own copies.
    """
    spark = docs.sparkSession
    d = texts(docs, id_col, text_col)
    sk = materialize(sketches(d, n), "sketches")
    known = sk.where("doc_id is not null and digest is not null")
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")), "classes")
    member = materialize(sk.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")), "members")
    reps = known.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    reps = materialize(reps.select(F.col("doc_id").alias("class_id"), "tie", "shingles", "sketch", "keys"), "reps")
    remove(spark, sk)
    sizes = classes.groupBy("class_id").agg(F.sum("size").alias("size"))
    linked = components(star_edges(reps, threshold), "regions")
    regions = materialize(linked.select(F.col("node").alias("class_id"), F.col("component").alias("region")).join(sizes, "class_id"), "regions")
    found = links(d, reps, regions, threshold, n)
    remove(spark, reps)
    remove(spark, regions)
    groups = components(found.where("b is not null").select("a", "b"), "groups").select(F.col("node").alias("copy_id"), F.col("component").alias("class_id"))
    counts = found.where("b is null").groupBy(F.col("a").alias("copy_id")).agg(F.sum("n_texts").alias("n_links"), F.sum("n_docs").alias("n_linked"))
    per_class = classes.select("digest", F.col("class_id").alias("copy_id"), "size").join(groups, "copy_id", "left").join(counts, "copy_id", "left")
    member = member.join(per_class, "digest", "left")
    return member.select(
        "doc_id",
        F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("n_linked", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_linked_docs"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the least of its group; rows with a null id stay."""
    out = near_duplicates(docs, threshold, n, id_col, text_col)
    drop = out.where("doc_id <> class_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
