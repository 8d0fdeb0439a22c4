"""Toxicity by a counterfactually regularised logistic classifier.

Features are the presence of words (lower case, letters only) and of beginnings of words. For every labelled text that holds
an identity term, the text with the term swapped for each other term of its group is its
counterfactual; the squared change of the score's logit is added to the loss, so that a label that
happens to go with a group moves onto the other words of the text. A swap takes the term's beginnings with
it, where no other word of the text has them, and brings those of the other term, seen in the sample or not.

The classifier is fitted on a bounded sample: at most ``max_labels`` labelled training rows, chosen by
a hash of the id, and on every feature of theirs whose presence differs between the classes by
``min_z`` standard errors in ``min_rows`` rows or more. All texts are scored, whole.

Defined results: a null or empty text has the score of a text without any known word; null labels
teach nothing; an id with several labels is toxic if one says so; without both classes among the
training rows every score is the share of toxic ones (0 without rows).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

_WORD = re.compile(r"[^\W\d_]+")

#: Groups of identity terms that are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("african", "american", "european", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "immigrants", "refugee", "refugees", "citizen", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)


#: A word also gives its beginnings of these lengths, so that an inflected insult is known by its stem.
STEMS = (4, 5, 6, 7)


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> set[str]:
    """Words, and their beginnings marked by a trailing star."""
    w = words(text)
    return w.union(*({x[:k] + "*" for x in w if len(x) > k} for k in STEMS))


def swaps(present: set[str], known: set[str] | frozenset[str], groups=IDENTITY_TERMS):
    """(group, leaving, entering) of every counterfactual of a text with these features: known features that change."""
    terms = [(g, a) for g, group in enumerate(groups) for a in group if a in present]
    plain = [x for x in present if not x.endswith("*")] if terms else []
    for g, a in terms:
        stay = set().union(*(features(x) for x in plain if x != a and x[: min(STEMS)] == a[: min(STEMS)]))
        leaving = features(a) - stay
        for b in groups[g]:
            if b != a:
                new = features(b)
                yield g, sorted((leaving - new) & known), sorted((new - present) & known)


def training_ids(labels: DataFrame, max_labels: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """At most ``max_labels`` labelled training ids with their label."""
    d = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = d.groupBy("doc_id").agg(F.max("y").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.known = bias, weights, frozenset(weights)

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.known & features(text)))) if text else self.bias
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def fit(rows: list[tuple[int, list[int]]], vocabulary: list[str], ridge: float = 1.0, swap: float = 4.0, steps: int = 12, groups=IDENTITY_TERMS, swapped=None) -> Model:
    """Newton's method on logistic loss + ridge * |w|^2 / 2 + swap * squared logit change, mean over a term's swaps / 2.

    rows: (label, indices of the features present). swapped: number of texts by (group, leaving, entering) of
    swaps(); without it, the rows' own features are taken for whole texts.
    """
    n, k = len(rows), len(vocabulary)
    y = np.array([r[0] for r in rows], float)
    if not n or y.min() == y.max():
        rate = float(y.mean()) if n else 0.0
        return Model(float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))), {})
    # Ones at (row, feature), the bias being feature k; only these are stored, so any number of features fits.
    size = np.array([len(r[1]) for r in rows])
    row = np.concatenate([np.repeat(np.arange(n), size), np.arange(n)])
    col = np.concatenate([np.fromiter((i for r in rows for i in r[1]), np.int64, int(size.sum())), np.full(n, k)])
    index = {w: i for i, w in enumerate(vocabulary)}
    ridges = np.full(k + 1, ridge, float)
    ridges[k] = 1e-6
    if swapped is None:
        swapped = Counter((g, tuple(a), tuple(b)) for _, at in rows for g, a, b in swaps({vocabulary[i] for i in at}, index.keys(), groups))
    # A swap moves its texts' logit by the weights that enter less those that leave.
    cells = [(i, index[v], sign) for i, (_, leaving, entering) in enumerate(swapped) for part, sign in ((leaving, -1.0), (entering, 1.0)) for v in part]
    which, at, sign = (np.array(x, t) for x, t in zip(zip(*cells, strict=True) if cells else ((), (), ()), (np.int64, np.int64, float), strict=True))
    force = np.array([m * swap / max(1, len(groups[g]) - 1) for (g, _, _), m in swapped.items()], float)

    def logits(v):
        return np.bincount(row, v[col], n)

    def back(u):
        return np.bincount(col, u[row], k + 1)

    def penalty(v):
        moved = force * np.bincount(which, sign * v[at], len(force))
        return ridges * v + np.bincount(at, sign * moved[which], k + 1)

    def solve(curve, g):
        """Conjugate gradients on the Hessian, scaled by its diagonal."""
        scale = back(curve) + ridges + np.bincount(at, force[which], k + 1)
        v, left = np.zeros(k + 1), g.copy()
        z = left / scale
        d, rz = z.copy(), left @ z
        for _ in range(2000):
            if np.abs(left).max() <= 1e-9 * max(1.0, np.abs(g).max()):
                break
            h = back(curve * logits(d)) + penalty(d)
            a = rz / (d @ h)
            v += a * d
            left -= a * h
            z = left / scale
            rz, old = left @ z, rz
            d = z + rz / old * d
        return v

    w = np.zeros(k + 1)
    w[k] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(logits(w), -30, 30)))
        step = solve(np.maximum(p * (1 - p), 1e-6), back(p - y) + penalty(w))
        w -= step * min(1.0, 8 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(float(w[k]), {v: float(w[i]) for i, v in enumerate(vocabulary)})


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, min_rows: int = 5, min_z: float = 3.5, groups=IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    ids = training_ids(labels, max_labels, id_col, label_col)
    ids = spark.createDataFrame([(r["doc_id"], r["y"]) for r in ids.collect()], "doc_id long, y int")  # bounded by max_labels
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")

    def tokens(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(features(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "y", "w"])

    bags = d.mapInArrow(tokens, "doc_id long, y int, w array<string>").persist()
    try:
        total = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = total.get(1, 0), total.get(0, 0)
        terms = [t for g in groups for t in g]
        per_word = bags.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n")).withColumn("b", F.col("n") - F.col("a"))
        # Difference of the word's share in both classes over its standard error.
        share = F.col("n") / F.lit(max(1.0, n1 + n0))
        z = (F.col("a") / F.lit(max(1.0, n1)) - F.col("b") / F.lit(max(1.0, n0))) / F.sqrt(share * (1 - share + 1e-9) * (1 / max(1, n1) + 1 / max(1, n0)))
        passing = per_word.where((F.col("n") >= min_rows) & (F.abs(z) >= min_z) | F.col("w").isin(terms))
        vocabulary = sorted(r["w"] for r in passing.select("w").collect())  # at least min_rows of the labelled sample hold each
        at = {v: i for i, v in enumerate(vocabulary)}

        def present(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(at[v] for v in w if v in at) for w in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "y", "w"])

        rows = bags.mapInArrow(present, "doc_id long, y int, w array<int>").collect()  # max_labels rows of known features
        known = frozenset(vocabulary)

        def changes(batches):
            for b in batches:
                out = [c for w in b.column(0).to_pylist() for c in swaps(set(w), known, groups)]
                g, leaving, entering = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(leaving, pa.list_(pa.string())), pa.array(entering, pa.list_(pa.string()))], names=["g", "leaving", "entering"])

        # The stems that stay or are there already are nested, so a pair of terms has a few dozen different swaps at most.
        different = bags.select("w").mapInArrow(changes, "g int, leaving array<string>, entering array<string>").groupBy("g", "leaving", "entering").count()
        swapped = {(r["g"], tuple(r["leaving"]), tuple(r["entering"])): r["count"] for r in different.orderBy("g", "leaving", "entering").collect()}
    finally:
        bags.unpersist()
    return fit([(r["y"], r["w"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["y"], r["w"]))], vocabulary, groups=groups, swapped=swapped)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every document. The model is bounded by the labelled sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = [shared.value.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "score", "predicted"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
