"""Language identification by hierarchical discrimination.

A text's features are hashed counts of its 1- to 3-letter sequences (lower case, anything but
letters as a gap), square-rooted and scaled to length one. One-versus-rest linear support vector
machines choose the language family; inside it, one-versus-one machines for every pair of its
languages vote, and the sum of their margins settles ties.

The classifier is fitted on the driver on a bounded sample: at most ``per_lang`` training rows of
each language, chosen by a hash of the id. All texts are scored, whole.

Defined results: ``und`` with score 0 for a null text or one without letters; rows with a null
language teach nothing; a language outside ``FAMILIES`` is a family of its own; without any
training row every text is ``und``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "sk", "cs", "pl"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}
DIM = 1 << 13
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of 1- to 3-letter sequences; None without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run of other characters becomes one gap
    c = np.where(letter, c, 32)[keep].astype(np.uint32)
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
    one, two = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
    pair = one[:-1] ^ (two[1:] << np.uint32(5) | two[1:] >> np.uint32(27))
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ one[2:]
    out = np.zeros(DIM, np.int64)
    for h in (one[c != 32], pair, triple):
        h = h ^ h >> np.uint32(15)
        out += np.bincount((h * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64), minlength=DIM)
    return out


def features(text: str) -> np.ndarray | None:
    n = counts(text)
    if n is None:
        return None
    x = np.sqrt(n, dtype=np.float32)
    return x / np.linalg.norm(x)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 150) -> np.ndarray:
    """Squared-hinge linear SVM with a bias, by accelerated gradient descent; classes weigh alike. y is -1 or 1."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y) * cost
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):  # largest eigenvalue of the weighted Gram matrix
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v)
    lip = 1 + 2 * float(v @ (x.T @ (weight * (x @ v))))
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - (z - 2 * x.T @ (weight * y * slack)) / np.float32(lip)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = new + np.float32((last - 1) / t) * (new - w), new
    return w


class Model:
    """Weights of all machines side by side, so that one product scores a text."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] | None = None):
        of = {x: k for k, v in (families or FAMILIES).items() for x in v}
        self.langs = sorted(set(langs))
        self.groups: dict[str, list[str]] = {}
        for lang in self.langs:
            self.groups.setdefault(of.get(lang, f"={lang}"), []).append(lang)
        y, columns = np.array(langs), []
        self.families = sorted(self.groups)
        for f in self.families if len(self.families) > 1 else []:
            columns.append(fit_svm(x, np.where(np.isin(y, self.groups[f]), 1, -1).astype(np.float32)))
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.groups[f], 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = len(columns)
                columns.append(fit_svm(x[rows], np.where(y[rows] == a, 1, -1).astype(np.float32)))
        self.weights = np.stack(columns, 1) if columns else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        m = x @ self.weights[:-1] + self.weights[-1]
        sure = 1.0
        k = 0
        if len(self.families) > 1:
            k = int(m[: len(self.families)].argmax())
            sure = _logistic(m[k])
        group = self.groups[self.families[k]]
        votes = {a: [0, 0.0] for a in group}
        for a, b in combinations(group, 2):
            v = float(m[self.pairs[a, b]])
            votes[a if v >= 0 else b][0] += 1
            votes[a][1] += v
            votes[b][1] -= v
        best = max(group, key=lambda g: (votes[g][0], votes[g][1], g))
        if len(group) > 1:
            sure *= min(_logistic(float(m[self.pairs[a, b]]) * (1 if a == best else -1)) for a, b in combinations(group, 2) if best in (a, b))
        return best, float(sure)


def _logistic(v: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, 3 * v)))))


def sample(docs: DataFrame, per_lang: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """At most ``per_lang`` rows (lang, text) of each language, chosen by a hash of the id."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return d.select("lang", "text")
    shares = spark.createDataFrame([(k, min(1.0, 3 * per_lang / n)) for k, n in sizes.items()], "lang string, share double")
    at = F.xxhash64(F.coalesce("doc_id", F.lit(-1)))
    # About three times the sample by a threshold on the hash; its ids are ranked and cut exactly.
    near = d.join(F.broadcast(shares), "lang").where(F.pmod(at, F.lit(1_000_003)) < F.col("share") * 1_000_003)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(at, "doc_id", F.xxhash64("text")))
    return near.withColumn("k", rank).where(F.col("k") <= per_lang).select("lang", "text")


def train(docs: DataFrame, per_lang: int = 500, families: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    def run(batches):
        for b in batches:
            got = [(lang, x) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].astype("<f2").tobytes() for g in got], pa.binary())], names=["lang", "x"])

    rows = sample(docs, per_lang, id_col, text_col, lang_col).mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the same model whatever the order of tasks
    return Model(np.stack([np.frombuffer(r["x"], "<f2").astype(np.float32) for r in rows]), [r["lang"] for r in rows], families)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document. The model is some MB, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                x = features(t) if t and m else None
                out.append(("und", 0.0) if x is None else m.predict(x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
