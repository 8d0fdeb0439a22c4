"""What the operators of this package share: tables, shared scratch space, hashing kernels.

Every operator takes a DataFrame with (at least) an id and a text column, selects only the
columns that it needs and so does not mind extra columns with clashing names.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; a scan with fewer partitions than cores, as one small file has, is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if name in ("documents", "pages") and df.rdd.getNumPartitions() < n else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows go to Python workers at most ``rows`` at a time: texts are long, and the default of 10,000 is meant for short rows.

    Results are lazy, so this holds for the session from then on. The registered queries and the
    pipeline call it; the operators leave the session's settings alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with a null text as the empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only if it is unset and the session is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.gettempdir()}/lodestar-scratch"
    return place.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestar-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: written once to the shared folder and read back, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, tag)
    with _shuffle_files_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffle_files_go(spark: SparkSession):
    """Shuffle files of what runs inside are deleted when it ends, not when the driver's collector gets to them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def remove(spark: SparkSession, df_or_path) -> None:
    """Deletes scratch data that no later plan reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    for p in paths:
        if "/lodestar-" in p:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (xor-shift and multiply), in place on a fresh array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for later calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            k = 1
            while k < size:  # doubling
                p[k : 2 * k] = p[:k] * np.uint64(pow(b, k, 2**64))
                k *= 2
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Polynomial hashes of any substring of a byte string, from one pass of prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: self.n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k-byte window."""
        m = self.n - k + 1
        return mix64((self.sums[k : k + m] - self.sums[:m]) * self.down[:m] ^ np.uint64(k))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(texts_: list[str], segment: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words before each text and after the last.

    Works in segments that end at white space, so memory stays bounded for any length of a text.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts_]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + segment)
        while end < len(data):  # up to the next white space
            part = data[end : end + segment]
            space = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(space):
                end += int(space[0])
                break
            end += len(part)
        part = data[at:end]
        s, e = word_spans(part)
        hashes.append(Rolling(part).spans(s, e))
        starts.append(s + at)
        at = end
    starts_ = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.searchsorted(starts_, ends)))
