"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The ids are those of the sentencepiece library. Documents of ordinary length go to the library
whole. A giant one is cut anywhere into chunks that are encoded apart:

* A segmentation is the model's if and only if every two neighbouring pieces are what the model
  makes of their own concatenation, so encoding is a best path in a lattice whose edges are pieces,
  with weight -1 for a piece that suits the one before and minus infinity for one that does not.
* At a chunk boundary the state is the piece that covers the character before it. A chunk yields its
  transfer matrix from every possible entry state to every exit state: the best weight between them.
* Matrices combine associatively in (max, +). A prefix scan of them over a document's chunks, a
  small table beside the text, fixes each chunk's entry and exit state.
* Each chunk then traces its pieces back alone, and its ids join the document's.

No piece reaches over the start of a run of word marks, so every path passes there: a chunk's matrix
is a column up to its first such place times a row from its last, and what lies between is one
known segmentation. Chunks without one go through the lattice from end to end.

Defined results: a null or empty text has no ids; rows that repeat an id are encoded each; decoding
gives the text back except for the word mark U+2581, which decodes to a space.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import materialize
from .tokens import tokenizer_path

MARK = "▁"
GIANT, CHUNK = 1 << 16, 1 << 14  # characters
SLICE = 256  # documents that go to the library at once

State = tuple[int, str]  # (characters past the boundary, the piece that ends there)
Matrix = dict[State, dict[State, float]]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The (max, +) product."""
    out: Matrix = {}
    for s, row in a.items():
        new: dict[State, float] = {}
        for mid, w in row.items():
            for t, v in b.get(mid, {}).items():
                if w + v > new.get(t, -np.inf):
                    new[t] = w + v
        if new:
            out[s] = new
    return out


def prefix_products(m: list[Matrix]) -> list[Matrix]:
    """Products of the first 1, 2, ... matrices, by the work-efficient scan: pairs, then their prefixes, then the gaps."""
    if len(m) < 2:
        return list(m)
    inner = prefix_products([combine(m[i], m[i + 1]) for i in range(0, len(m) - 1, 2)])
    return [m[0] if i == 0 else inner[i // 2] if i % 2 else combine(inner[i // 2 - 1], m[i]) for i in range(len(m))]


class Pieces:
    """The model as the lattice sees it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only byte-pair models without normalisation can be cut into chunks")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.score))
        self.closed = not any(MARK in p.lstrip(MARK) for p in self.score)  # marks stand only at the start of pieces
        self.merges = lru_cache(1 << 16)(self._merges)

    def _merges(self, text: str) -> tuple[str, ...]:
        """What the model makes of a short string: the best-scored neighbours join first, the leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            best, at = -np.inf, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and v > best:
                    best, at = v, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return tuple(s)

    def suits(self, before: str, piece: str) -> bool:
        return not before or self.closed and piece[0] == MARK and before[-1] != MARK or self.merges(before + piece) == (before, piece)

    def from_here(self, x: str, p: int) -> list[str]:
        """The pieces that may start at p."""
        out = []
        for n in range(1, min(self.longest, len(x) - p) + 1):
            s = x[p : p + n]
            if n == 1 or s in self.score and self.merges(s) == (s,):
                out.append(s)
        return out

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def known(self, marked: str) -> list[int]:
        """Ids of a string that starts with a mark, by the library."""
        return self.sp.encode(marked[1:])

    def paths(self, x: str, p: int, before: str, end: int):
        """Best paths from (p, after ``before``) over the pieces that start before ``end``.

        Returns the exit states {(position, piece): weight} and, for each state, the one before it.
        """
        at: dict[int, dict[str, float]] = {p: {before: 0.0}}
        back: dict[State, State] = {}
        out: dict[State, float] = {}
        if p >= end:
            return {(p, before): 0.0}, back
        for q in range(p, end):
            states = at.pop(q, None)
            if not states:
                continue
            for piece in self.from_here(x, q):
                best = None
                for last, w in states.items():
                    if (best is None or w > best[0]) and self.suits(last, piece):
                        best = (w, last)
                if best is None:
                    continue
                e, w = q + len(piece), best[0] - 1
                to = out if e >= end else None
                if to is not None:
                    if w > out.get((e, piece), -np.inf):
                        out[e, piece] = w
                        back[e, piece] = (q, best[1])
                elif w > at.setdefault(e, {}).get(piece, -np.inf):
                    at[e][piece] = w
                    back[e, piece] = (q, best[1])
        return out, back

    def marks(self, x: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and last place in lo+1..hi-1 that no piece reaches over."""
        if not self.closed:
            return None
        first = next((p for p in _finds(x, MARK, lo + 1, hi) if x[p - 1] != MARK), None)
        if first is None:
            return None
        p = x.rfind(MARK, first, hi)
        while p > first and x[p - 1] == MARK:
            p = x.rfind(MARK, first, p)
        return first, max(p, first)


def _finds(x: str, c: str, lo: int, hi: int):
    while (lo := x.find(c, lo, hi)) >= 0:
        yield lo
        lo += 1


def entries(pc: Pieces, x: str, b: int) -> list[State]:
    """The states at boundary b: every piece that covers the character before it."""
    return [(a + len(s) - b, s) for a in range(max(0, b - pc.longest), b) for s in pc.from_here(x, a) if a + len(s) >= b]


def _ends(exits: dict[State, float], b: int, size: int, last: bool) -> dict[State, float]:
    if not last:
        return {(e - b, s): w for (e, s), w in exits.items()}
    w = [w for (e, _), w in exits.items() if e == size]
    return {(0, ""): max(w)} if w else {}


def transfer(pc: Pieces, left: str, chunk: str, right: str, first: bool, last: bool) -> Matrix:
    """The chunk's matrix. ``left`` and ``right`` are the neighbouring characters, at least a piece's length of them."""
    x, b = left + chunk + right, len(left)
    b2 = b + len(chunk)
    starts = [(0, "")] if first else entries(pc, x, b)
    m = pc.marks(x, b, b2)
    out: Matrix = {}
    if m is None:
        for s in starts:
            if row := _ends(pc.paths(x, b + s[0], s[1], b2)[0], b2, len(x), last):
                out[s] = row
        return out
    p1, p2 = m
    middle = -float(len(pc.known(x[p1:p2]))) if p2 > p1 else 0.0
    tail = _ends(pc.paths(x, p2, "", b2)[0], b2, len(x), last)
    for s in starts:
        if b + s[0] <= p1:
            w = max((w for (e, _), w in pc.paths(x, b + s[0], s[1], p1)[0].items() if e == p1), default=None)
            if w is not None:
                out[s] = {t: w + middle + v for t, v in tail.items()}
    return out


def _trace(pc: Pieces, x: str, p: int, before: str, end: int, to: State | None) -> list[str]:
    out, back = pc.paths(x, p, before, end)
    s = to if to is not None else max((s for s in out if s[0] == end), key=lambda s: out[s])
    pieces: list[str] = []
    while s != (p, before):
        pieces.append(s[1])
        s = back[s]
    return pieces[::-1]


def traceback(pc: Pieces, left: str, chunk: str, right: str, entry: State, leave: State, last: bool) -> list[int]:
    """The ids of the pieces that start in the chunk, or after the entry state's piece, up to the exit state's piece."""
    x, b = left + chunk + right, len(left)
    b2 = b + len(chunk)
    to = None if last else (b2 + leave[0], leave[1])
    m = pc.marks(x, b, b2)
    if m is None:
        return pc.to_ids(_trace(pc, x, b + entry[0], entry[1], b2, to))
    p1, p2 = m
    head = pc.to_ids(_trace(pc, x, b + entry[0], entry[1], p1, None))
    return head + (pc.known(x[p1:p2]) if p2 > p1 else []) + pc.to_ids(_trace(pc, x, p2, "", b2, to))


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


_CHUNKS = "rid long, idx int, n int, head string, chunk string, tail string"


def _dump(m: Matrix) -> str:
    return json.dumps([[*s, [[*t, w] for t, w in row.items()]] for s, row in m.items()])


def _load(text: str) -> Matrix:
    return {(a, s): {(b, t): w for b, t, w in row} for a, s, row in json.loads(text)}


def _ids_frame(cols: dict[str, pa.Array], ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*cols.values(), pa.array(ids, pa.binary())], names=[*cols, "ids"])


def encode(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, text, ids, n_chunks[, decoded]) of every document; ids are little-endian unsigned 32-bit.

    With ``decoded`` the ids of ordinary documents are decoded by the worker that made them.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches):
        sp = pieces_of(path).sp
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                ids = sp.encode(part.column(1).to_pylist(), num_threads=1)
                cols = [part.column(0), part.column(1), pa.array([array("I", x).tobytes() for x in ids], pa.binary()), pa.array([1] * len(ids), pa.int32())]
                if decoded:
                    cols.append(pa.array(sp.decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "ids", "n_chunks", "decoded"][: len(cols)])

    small = d.where(F.length("text") <= giant).mapInArrow(whole, "doc_id long, text string, ids binary, n_chunks int" + ", decoded string" * decoded)
    big = materialize(d.where(F.length("text") > giant).withColumn("rid", F.monotonically_increasing_id()), "giant")
    if big.isEmpty():
        return small

    def split(batches):
        side = pieces_of(path).longest + 1
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = MARK + text.replace(" ", MARK)
                at = list(range(0, max(1, len(x) - chunk // 2), chunk))
                rows = [(rid, i, len(at), x[max(0, a - side) : a], x[a : e], x[e : e + side]) for i, (a, e) in enumerate(zip(at, [*at[1:], len(x)], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["rid", "idx", "n", "head", "chunk", "tail"])

    parts = materialize(big.select("rid", "text").mapInArrow(split, _CHUNKS).repartition("rid", "idx"), "chunks")

    def matrices(batches):
        pc = pieces_of(path)
        for b in batches:
            out = [_dump(transfer(pc, h, c, t, i == 0, i == n - 1)) for i, n, h, c, t in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["rid", "idx", "m"])

    table = materialize(parts.mapInArrow(matrices, "rid long, idx int, m string"), "matrices")

    def scan(key, frame):
        frame = frame.sort_by("idx")
        m = [_load(x) for x in frame["m"].to_pylist()]
        done = prefix_products(m)
        # The last product has one entry and one exit; back from it, each boundary's state is the one on the best path.
        to: State = (0, "")
        states = [to]
        for i in range(len(m) - 1, 0, -1):
            row = done[i - 1][0, ""]
            to = max((s for s in row if to in m[i].get(s, {})), key=lambda s: (row[s] + m[i][s][to], s))  # noqa: B023
            states.append(to)
        states = [(0, ""), *states[::-1]]
        return pa.table({"rid": frame["rid"], "idx": frame["idx"], "e0": [s[0] for s in states[:-1]], "s0": [s[1] for s in states[:-1]], "e1": [s[0] for s in states[1:]], "s1": [s[1] for s in states[1:]]})

    # A document's matrices are a fraction of its text, which is one row already.
    states = table.groupBy("rid").applyInArrow(scan, "rid long, idx int, e0 long, s0 string, e1 long, s1 string")

    def back(batches):
        pc = pieces_of(path)
        for b in batches:
            r = [b.column(k).to_pylist() for k in ("idx", "n", "head", "chunk", "tail", "e0", "s0", "e1", "s1")]
            ids = [array("I", traceback(pc, h, c, t, (e0, s0), (e1, s1), i == n - 1)).tobytes() for i, n, h, c, t, e0, s0, e1, s1 in zip(*r, strict=True)]
            yield _ids_frame({"rid": b.column("rid"), "idx": b.column("idx")}, ids)

    traced = parts.join(states, ["rid", "idx"]).mapInArrow(back, "rid long, idx int, ids binary")
    joined = traced.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("idx", "ids"))).alias("p")).select("rid", F.transform("p", lambda p: p["ids"]).alias("p"))
    large = big.join(joined, "rid").select("doc_id", "text", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.size("p").alias("n_chunks"))
    return small.unionByName(decode(large, path) if decoded else large)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds decoded (string) to rows with ids, by the library."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches):
        sp = pieces_of(path).sp
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                ids = [np.frombuffer(x, "<u4").tolist() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sp.decode(ids) if ids else [], pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32, n_chunks, decoded_sha256, round_trip."""
    d = encode(docs, model, giant, chunk, id_col, text_col, decoded=True)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "n_chunks", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
