"""Token ids in sorted-string-table shards.

A shard is: data blocks, a block index, a Bloom filter, a footer. A data block holds entries in
key order, each as varint(shared key bytes), varint(new key bytes), varint(value bytes), the new
key bytes and the value; every ``RESTART`` entries a full key starts a restart point, and the block
ends with the restart offsets. The index has the last key of each block. ``Shard.get`` asks the
Bloom filter, searches the index, then the restart points, each by bisection.

Keys are ids in an order-preserving form: 0x00 for null, else 0x01 and the 8 bytes of the id,
big-endian with the sign bit flipped. Values are ids of 2 bytes where all fit, else of 4.

Defined results: a null or empty text holds the end id alone; ids that repeat keep all their
entries, in the order of their texts' hashes; null ids come first; an empty table has no shard.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as file_systems
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, texts
from .tokens import encoder, tokenizer_path

MAGIC = b"LSSST001"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, length; filter at, length; entries; tokens; id width; magic
RESTART, BLOCK, BITS, PROBES = 16, 1 << 16, 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b + i * i) % bits for i in range(PROBES)]


class ShardWriter:
    """Takes (key, ids as little-endian unsigned 32-bit bytes) in key order; ``finish`` returns the file's bytes."""

    def __init__(self, id_width: int):
        self.width, self.out, self.index, self.keys = id_width, bytearray(), [], []
        self.tokens, self.zstd = 0, zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: bytes) -> None:
        self.tokens += len(ids) // 4
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._close()

    def _close(self) -> None:
        if self.in_block:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            packed = self.zstd.compress(raw)
            self.index.append((self.last, len(self.out), len(packed)))
            self.out += packed + struct.pack("<I", zlib.crc32(packed))
            self._open()

    def finish(self) -> bytes:
        self._close()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.out)
        return bytes(self.out) + index + bytes(bloom) + FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.width, MAGIC)


class Shard:
    """Reads a shard from its bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        at, n, bloom_at, bloom_n, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard, or cut off")
        self.bloom = self.data[bloom_at : bloom_at + bloom_n]
        self.last, self.where, end, index = [], [], at + n, self.data
        while at < end:
            k, at = _read_varint(index, at)
            key = bytes(index[at : at + k])
            offset, at = _read_varint(index, at + k)
            size, at = _read_varint(index, at)
            self.last.append(key)
            self.where.append((offset, size))

    def _block(self, i: int) -> bytes:
        at, n = self.where[i]
        packed = self.data[at : at + n]
        if zlib.crc32(packed) != struct.unpack("<I", self.data[at + n : at + n + 4])[0]:
            raise ValueError(f"block {i} is damaged")
        return zstandard.ZstdDecompressor().decompress(packed)

    def _entries(self, block: bytes, at: int = 0):
        end, key = len(block) - 4 - 4 * struct.unpack("<I", block[-4:])[0], b""
        while at < end:
            shared, at = _read_varint(block, at)
            new, at = _read_varint(block, at)
            n, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + new]
            at += new
            yield key, np.frombuffer(block, f"<u{self.width}", n // self.width, at).astype("<u4")
            at += n

    def __iter__(self):
        for i in range(len(self.where)):
            yield from self._entries(self._block(i))

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        for i in range(bisect_left(self.last, key), len(self.where)):
            block = self._block(i)
            n = struct.unpack("<I", block[-4:])[0]
            starts = struct.unpack(f"<{n}I", block[-4 - 4 * n : -4])
            first = bisect_left(starts, key, key=lambda at: next(self._entries(block, at))[0])
            for k, ids in self._entries(block, starts[max(0, first - 1)]):
                if k > key:
                    return out
                if k == key:
                    out.append(ids)
        return out


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a whole file under another name first, so that a lost or repeated task leaves no half file.

    Any file system that pyarrow knows by its URI will do (file, hdfs, s3, gs, ...).
    """
    if folder.startswith("file:") or "://" not in folder:
        path = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(path, exist_ok=True)
        with open(part := f"{path}/_{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")
    else:
        fs, path = file_systems.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(part := f"{path}/_{uuid.uuid4().hex}") as f:
            f.write(data)
        fs.move(part, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents in ascending id order; returns the stored manifest, one row per shard.

    Documents are range-partitioned by (id, text hash), so shards follow each other in id order
    and a repeated id can spread over several.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, k, w = TaskContext.get().partitionId(), 0, None

        def close():
            data = w.finish()
            name = f"shard-{part:06d}-{k:05d}.sst"
            _put(folder, name, data)
            return pa.RecordBatch.from_pylist([{"shard": name, "n_docs": len(w.keys), "n_tokens": w.tokens, "n_bytes": len(data)}], schema=schema)

        schema = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = w or ShardWriter(width)
                w.add(key_of(doc_id), enc.encode(text) + end)
                if len(w.out) >= shard_bytes:
                    yield close()
                    k, w = k + 1, None
        if w:
            yield close()

    # Text hashes are the second key of the order alone; texts move once.
    d = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "shard string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_shards(spark, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the manifest's shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32[, ids]."""
    # One row per shard of tens of MB: the manifest is a hundred-thousandth of the data.
    base = manifest.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")

    def run(batches):
        for b in batches:
            for data, base in zip(b.column("content"), b.column("base").to_pylist(), strict=True):
                cols = [[], [], [], [], []]
                for key, ids in Shard(data.as_py()):
                    for c, v in zip(cols, (id_of(key), base, len(ids), zlib.crc32(ids), ids), strict=True):
                        c.append(v)
                    base += len(ids)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.uint32())]
                arrays = [pa.array(c, t) for c, t in zip(cols[:4], kinds, strict=False)]
                if with_ids:
                    arrays.append(pa.array([x.astype("int64") for x in cols[4]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.join(base, "shard").mapInArrow(run, schema)


def tokens_through_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sstable")
    manifest = write_shards(docs, folder, tokenizer, end_id, id_col=id_col, text_col=text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest)
