"""Maximal periodic runs of words, by heavy/light lag counting.

A run is a stretch of words with smallest period q and at least max(12, 2 q) words that no neighbour
extends. Inside it max(q, 12 - q) places in a row hold the word that is q further on, so lag q has that
many matches in the whole text. The matches of every lag are counted exactly, all texts of a batch
together for words that are rare in their text (differences of the places of a word, one offset in
its list of places at a time), text by text for words that are frequent (autocorrelation by FFT, counts
being integers far below the precision of doubles). Only lags with enough matches are scanned: a
stretch of that many places holds a multiple of its length, so islands grow from these places alone. A
place inside a known run whose period divides the lag is passed over, as its island is that run.

The cost of a text of n words is n log n and its islands, also for texts of one word repeated.

Defined results: null and empty texts have no words and no run; a null id counts as the empty text in its
checksum; every row gives one row, repeated ids too.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Tokens that are handled together; a longer text is handled alone.
BATCH = 400_000
#: Places of a text that are tested at a time.
PLACES = 1 << 21


def needed(q):
    """Matches in a row that a run of period q holds at lag q."""
    return np.maximum(q, LEAST - q)


def lag_matches(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For texts ids[ends[i-1]:ends[i]] the matches at every lag up to half the text, side by side.

    The lags 1..n // 2 of text i are at offset sum of (n // 2) of the texts before.
    """
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    half = sizes // 2
    base = np.concatenate(([0], np.cumsum(half)))
    out = np.zeros(base[-1], np.int64)
    if not len(out):
        return out
    doc = np.repeat(np.arange(len(ends)), sizes)
    order = np.lexsort((ids, doc))  # stable, so places ascend within a word
    word, of = ids[order], doc[order]
    first = np.concatenate(([True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])))
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(word)))
    n = sizes[of[at]]
    heavy = count.astype(float) ** 2 > np.maximum(1024, 14.0 * n)
    left = np.repeat(np.where(heavy, 0, count), count) - (np.arange(len(word)) - np.repeat(at, count))  # members from here on, itself too
    here = np.flatnonzero(left > 1)
    k = 1
    while len(here):
        d = order[here + k] - order[here]
        t = of[here]
        ok = d <= half[t]
        out += np.bincount(base[t[ok]] + d[ok] - 1, minlength=len(out)) if ok.sum() * 4 > len(out) else 0
        if ok.sum() * 4 <= len(out):
            np.add.at(out, base[t[ok]] + d[ok] - 1, 1)
        k += 1
        here = here[left[here] > k]
    big = np.flatnonzero(heavy)
    for t in np.unique(of[at[big]]):
        m, mine = int(sizes[t]), big[of[at[big]] == t]
        size = 1 << int(m + half[t]).bit_length()
        power = np.zeros(size // 2 + 1)
        for g in mine:
            x = np.zeros(size)
            x[order[at[g] : at[g] + count[g]] - starts[t]] = 1
            f = np.fft.rfft(x)
            power += f.real**2 + f.imag**2
        out[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, size)[1 : half[t] + 1]).astype(np.int64)
    return out


def _reach(w: np.ndarray, a: int, q: int) -> tuple[int, int]:
    """Bounds [l, r) of the stretch of places around ``a`` that match at lag q."""
    n, step, r, left = len(w) - q, 64, a + 1, a
    while r < n:
        differ = np.flatnonzero(w[r : min(n, r + step)] != w[r + q : min(n, r + step) + q])
        if len(differ):
            r += int(differ[0])
            break
        r, step = min(n, r + step), step * 2
    step = 64
    while left > 0:
        lo = max(0, left - step)
        differ = np.flatnonzero(w[lo:left] != w[lo + q : left + q])
        if len(differ):
            left = lo + int(differ[-1]) + 1
            break
        left, step = lo, step * 2
    return left, r


def find_runs(ids: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    half = (ends - starts) // 2
    base = np.concatenate(([0], np.cumsum(half)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    counts = lag_matches(ids, ends)
    text = np.repeat(np.arange(len(ends)), half)
    lag = np.arange(len(counts)) - base[text] + 1
    enough = np.flatnonzero(counts >= needed(lag))
    text, lag = text[enough], lag[enough]
    each = -(-(ends[text] - starts[text] - lag) // needed(lag))  # multiples of the least stretch below n - q
    upto = np.cumsum(each)
    i = 0
    while i < len(lag):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PLACES, "right")))
        size = each[i:j]
        q = np.repeat(lag[i:j], size)
        t = np.repeat(text[i:j], size)
        a = (np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)) * needed(q) + starts[t]
        keep = ids[a] == ids[a + q]
        q, t, a = q[keep], t[keep], a[keep]
        total, live = np.ones(len(a), np.int64), np.arange(len(a))
        for side in (1, -1):  # any island has six matches in a row
            live = np.arange(len(a))
            for s in range(1, 6):
                x = a[live] + side * s
                inside = (x >= starts[t[live]]) & (x + q[live] < ends[t[live]])
                live, x = live[inside], x[inside]
                live = live[ids[x] == ids[x + q[live]]]
                total[live] += 1
                if not len(live):
                    break
        keep = total >= LEAST // 2
        q, t, a = q[keep], t[keep], a[keep] - starts[t[keep]]
        cut = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (t[1:] != t[:-1]), [True]))) if len(q) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            p, doc, places = int(q[lo]), int(t[lo]), a[lo:hi]
            for s, length, d in found[doc]:
                if length > p and p % d == 0:
                    places = places[(places < s) | (places + p >= s + length)]
            w = ids[starts[doc] : ends[doc]]
            while len(places):
                left, right = _reach(w, int(places[0]), p)
                if right - left >= max(p, LEAST - p):
                    found[doc].append((left, right - left + p, p))
                places = places[places >= right]
        i = j
    return [sorted(f, key=lambda x: (x[0], x[2])) for f in found]


def planted(doc_id, n: int) -> np.ndarray | None:
    """For a tenth of the ids, the word that each place takes: from word a on, the text repeats with period p."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapse(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words stay when every run is cut to its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        step[s + p] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) == 0


def periodic_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, the text with every run cut to one period, and the runs as an array of structs.

    ``plant`` first makes a tenth of the texts periodic (see planted), to test a detector on whole tables.
    """
    return _apply(docs, plant, id_col, text_col, digest=False)


def run_digests(docs: DataFrame, plant: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, n_runs, the longest run, and digests of the runs and of the collapsed text."""
    return _apply(docs, plant, id_col, text_col, digest=True)


def _apply(docs: DataFrame, plant: bool, id_col: str, text_col: str, digest: bool) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    schema = f"doc_id {id_type}, " + (
        ", ".join(f"{c} bigint" for c in longs) + ", runs_sha256 string, collapsed_sha256 string" if digest else "collapsed string, runs array<struct<start:bigint,length:bigint,period:bigint>>"
    )

    def rows(keys: list, words: list[list[bytes]], number: dict[bytes, int]):
        ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        ends = np.cumsum([len(ws) for ws in words])
        for key, ws, runs in zip(keys, words, find_runs(ids, ends), strict=True):
            if runs:
                stay = collapse(runs, len(ws))
                kept = b" ".join([w for w, s in zip(ws, stay.tolist(), strict=True) if s])
            else:
                kept = b" ".join(ws)
            if not digest:
                yield key, kept.decode("utf-8", "surrogatepass"), [{"start": s, "length": n, "period": p} for s, n, p in runs]
                continue
            best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else None
            told = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
            yield (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())

    def run(batches):
        types = out_types
        for b in batches:
            keys, words, number, size, out = [], [], {}, 0, []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space
                if plant and (at := planted(key, len(ws))) is not None:
                    ws = [ws[i] for i in at.tolist()]
                if words and size + len(ws) > BATCH:
                    out.extend(rows(keys, words, number))
                    keys, words, number, size = [], [], {}, 0
                for w in ws:
                    if w not in number:
                        number[w] = len(number)
                keys.append(key)
                words.append(ws)
                size += len(ws)
            if words:
                out.extend(rows(keys, words, number))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])

    long_, struct = pa.int64(), pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(d.schema["doc_id"].dataType)
    out_types = [("doc_id", id_arrow)] + ([(c, long_) for c in longs] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] if digest else [("collapsed", pa.string()), ("runs", pa.list_(struct))])
    return d.mapInArrow(run, schema)
