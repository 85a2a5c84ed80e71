"""Exact repeated-substring removal: depth-limited radix refinement of suffixes.

Only the first ``WIDTH`` = 100 bytes of a suffix matter, so suffixes (100-byte windows) are refined by most-significant
digits, and a group that is down to one member leaves after each pass:

1. first digit: the window's minimiser, the least hash of its 16-byte grams. Equal windows have equal minimisers, and
   neighbours mostly share one, so consecutive windows with one minimiser travel as one run (about one row for 43 bytes).
2. second digit: the whole text of the run. Runs with equal text hold pairwise equal windows: the first run keeps
   them, all others give them up, without looking at single windows.
3. third digit: for the windows of runs whose minimiser has several texts (or that overlap themselves), the half
   window beside the minimiser. Windows with most bytes left of it are keyed by the 42 bytes before it, the others by
   the 42 after it, and travel as pieces of text.
4. last digit: the 100 bytes themselves (a 128-bit digest). Pieces of rarely shared keys are sorted by it in groups of bounded size;
   keys shared by more than ``KEY_LIMIT`` pieces go as one row per window. The equal groups are exactly the
   repeated windows; all but the first give their bytes up.

"First" means smaller document id, then earlier start. Every pass is a grouped minimum, aggregated before the
shuffle, and a join back that Spark can split at hot keys, so a passage that very many documents share is
never in one task. Texts travel twice, compressed, by document id, for pass 3 and the cut.

Edge cases: null text is empty; texts shorter than a window keep everything; rows of one id with different
texts are told apart and ordered by a 32-bit hash of the text; identical rows count as one document (both keep the same bytes); a null id sorts first; an
empty table gives an empty result; extra columns are ignored. The remaining bytes need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import durable, text_or_empty

WIDTH = 100
GRAM = 16
GROUP = 8192  # pieces to a group
KEY_LIMIT = 32_768  # pieces of one key that may stay in a group
_CHUNK = 1 << 15  # bytes whose arrays stay in a core's cache
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)  # seeds of the two digests
_LEVEL = 3  # of the compression in which whole texts travel


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _grams(raw: np.ndarray, gram: int, seed: np.uint64 = _M1) -> np.ndarray:
    """One 64-bit hash per ``gram`` bytes (8 to 16)."""
    if len(raw) < gram:
        return np.zeros(0, np.uint64)
    word = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    return _mix((word[: len(raw) - gram + 1] * _M1) ^ _mix(word[gram - 8 :] * _M3 + seed))


def _hashes(raw: np.ndarray, width: int, gram: int, seed: np.uint64) -> np.ndarray:
    """One 64-bit hash per ``width`` bytes, by doubling; every step mixes, so equal sums do not make equal hashes."""
    h, have = _grams(raw, gram, seed), gram
    while have < width and len(h):
        step = min(have, width - have)
        h = _mix(h[:-step] * _M1 + h[step:])
        have += step
    return h


def _run_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Hash of the text of each run (window starts a to b), from the gram hashes ``h`` of stretches that cover it in turn."""

    def window(at: np.ndarray) -> np.ndarray:
        out = h[at]
        for k in (*range(gram, width - gram, gram), width - gram):
            out = _mix(out * _M1 + h[at + k])
        return out

    out = _mix(window(a) + (b - a).astype(np.uint64) * _M3)
    at = a + width
    open_ = np.flatnonzero(at < b)
    while len(open_):
        out[open_] = _mix(out[open_] * _M1 + window(at[open_]))
        at[open_] += width
        open_ = open_[at[open_] < b[open_]]
    return _mix(out * _M1 + window(b))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def runs_of(data: np.ndarray, lengths: np.ndarray, width: int, gram: int):
    """(document, start, last start, minimiser, text hash, self) of every run in concatenated texts."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    raw = np.ascontiguousarray(data)
    h = _grams(raw, gram)
    per = width - gram + 1
    least = _sliding(h, per, True)  # one value per window start
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - width + 1, 0))
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(lengths - width + 1, 0)) - np.maximum(lengths - width + 1, 0), np.maximum(lengths - width + 1, 0))
    starts = begins[doc] + inner  # all window starts that stay inside a document
    if not len(starts):
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    value = least[starts]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b = starts[first], starts[last]
    text_hash = _run_hashes(h, a, b, width, gram)
    # values whose gram occurs twice close by may make a run overlap itself
    anchors = np.flatnonzero(h[: len(least) + per - 1] == _sliding(np.concatenate([np.zeros(per - 1, np.uint64), least, np.zeros(per - 1, np.uint64)]), per, False))
    close = (h[anchors[1:]] == h[anchors[:-1]]) & (np.diff(anchors) <= per)
    twice = np.unique(h[anchors[1:][close]])
    key = value[first]
    return doc[first], a - begins[doc[first]], b - begins[doc[first]], key, text_hash, np.isin(key, twice)


def _chunks(texts: list[bytes]):
    """Index ranges of about ``_CHUNK`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _squeeze(batches):
    """Texts as compressed bytes, for the joins that move whole texts."""
    z = zstandard.ZstdCompressor(level=_LEVEL, write_checksum=False)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress(t) for t in _bytes_of(part.column(2))], pa.binary())], ["uid", "tag", "text"])


def _run_rows(width: int, gram: int):
    def run(batches):
        for batch in batches:
            uid, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = _bytes_of(batch.column(2))
            for i, j in _chunks(texts):
                data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                doc, a, b, key, text, own = runs_of(data, np.array([len(t) for t in texts[i:j]], np.int64), width, gram)
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(text), pa.array(uid[i:j][doc]), pa.array(tag[i:j][doc]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(own)], ["h", "c", "uid", "tag", "a", "b", "own"])

    return run


_RUN_DDL = "h long, c long, uid long, tag int, a int, b int, own boolean"


def _pieces_of(data: np.ndarray, runs: list, width: int, gram: int):
    """Sub-runs of one document: (side, start, stop of text, start of the half beside the gram).

    A window holds its minimiser gram and at least half of its other bytes on one side of it. Windows with that half on the
    left (right) form one sub-run per gram, keyed by the half next to the gram: equal windows fall under equal keys.
    """
    half = (width - gram) // 2
    raw = np.ascontiguousarray(data)
    for r in runs:
        a, b = r["a"], r["b"]
        part = raw[a : b + width]
        h = _grams(part, gram)
        at = a + np.flatnonzero(h.view(np.int64) == r["h"])
        s = a
        while s <= b:
            p = int(at[np.searchsorted(at, s)])  # the first occurrence in window s
            stop = min(b, p)
            left = min(stop, p - half)
            if s <= left:
                yield 0, s, left + width, p - half
            if max(s, left + 1) <= stop:
                yield 1, max(s, left + 1), stop + width, p + gram
            s = stop + 1


def _piece_rows(width: int, gram: int):
    """Sub-runs with their text and key."""
    half = (width - gram) // 2

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for uid, tag, text, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                runs = runs.as_py()
                if runs:
                    raw = z.decompress(text.as_py())
                    for side, lo, hi, near in _pieces_of(np.frombuffer(raw, np.uint8), runs, width, gram):
                        key = hashlib.blake2b(raw[near : near + half], digest_size=8, salt=bytes([side])).digest()
                        for col, x in zip(out, (int.from_bytes(key, "little", signed=True), uid.as_py(), tag.as_py(), lo, raw[lo:hi]), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array(out[4], pa.binary())], ["key", "uid", "tag", "a", "piece"])

    return run


def _windows_of(uid, tag, a, pieces: list[bytes], width: int):
    """All windows of some pieces: two digests, document, start."""
    n = np.array([len(p) for p in pieces], np.int64)
    k = n - width + 1
    w1, w2 = np.empty(int(k.sum()), np.uint64), np.empty(int(k.sum()), np.uint64)
    at = 0
    for i, j in _chunks(pieces):
        data = np.frombuffer(b"".join(pieces[i:j]), np.uint8)
        begin = np.repeat(np.cumsum(n[i:j]) - n[i:j] - np.cumsum(k[i:j]) + k[i:j], k[i:j])
        lo = begin + np.arange(len(begin))
        for out, seed in ((w1, _S1), (w2, _S2)):
            out[at : at + len(lo)] = _hashes(data, width, GRAM, seed)[lo]
        at += len(lo)
    inner = np.arange(at) - np.repeat(np.cumsum(k) - k, k)
    return w1, w2, np.repeat(uid, k), np.repeat(tag, k), np.repeat(a, k).astype(np.int64) + inner


def _repeats_in(width: int):
    """Later occurrences among the pieces of one group of keys, as ranges of starts."""

    def run(table: pa.Table) -> pa.Table:
        _, which, times = np.unique(table.column("key").to_numpy(), return_inverse=True, return_counts=True)
        table = table.filter(pa.array(times[which] > 1))  # a key of one piece repeats nothing
        uid, tag, a = (table.column(c).to_numpy() for c in ("uid", "tag", "a"))
        w1, w2, u, t, s = _windows_of(uid, tag, a, table.column("piece").to_pylist(), width)
        order = np.lexsort((s, t, u, w2, w1))
        w1, w2, u, t, s = w1[order], w2[order], u[order], t[order], s[order]
        equal = np.append(False, (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]))[: len(s)]
        head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(s))))
        again = np.flatnonzero((u != u[head]) | (t != t[head]) | (s != s[head]))  # the head itself comes again with each repeated row
        u, t, s = u[again], t[again], s[again]
        order = np.lexsort((s, t, u))
        u, t, s = u[order], t[order], s[order]
        other = np.append(True, (u[1:] != u[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1]))[: len(s)]
        u, t, s = u[other], t[other], s[other]
        new = np.ones(len(s), bool)
        new[1:] = (u[1:] != u[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1 if len(s) else first
        return pa.table({"uid": pa.array(u[first], pa.int64()), "tag": pa.array(t[first].astype(np.int32)), "a": pa.array(s[first].astype(np.int32)), "b": pa.array(s[last].astype(np.int32))})

    return run


def _window_rows(width: int):
    """The windows of pieces as rows, for keys that too many pieces share."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                uid, tag, a = (part.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "tag", "a"))
                w1, w2, u, t, s = _windows_of(uid, tag, a, part.column("piece").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(u, pa.int64()), pa.array(t.astype(np.int32)), pa.array(s.astype(np.int32))], ["w1", "w2", "uid", "tag", "s"])

    return run


def _cut(width: int, keep_text: bool):
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for uid, text, spans in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                data = z.decompress(text.as_py())
                mask = np.zeros(len(data) + 1, np.int32)
                for r in spans.as_py() or []:
                    mask[r["a"]] += 1
                    mask[r["b"] + width] -= 1
                gone = np.cumsum(mask[:-1]) > 0
                n = int(gone.sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                rows.append((uid.as_py(), len(data), n, len(edges) // 2, hashlib.sha256(kept).hexdigest(), *((kept,) if keep_text else ())))
            cols = list(zip(*rows, strict=True)) or [[]] * (5 + keep_text)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return run


_NULL = -(2**63)


def repeated_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, key_limit: int = KEY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(documents with compressed texts, covered): covered has uid, tag, a, b, ranges of window starts with an earlier equal window."""
    text = text_or_empty("text")
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("uid"), F.hash(text).alias("tag"), text.alias("text"))
    base = plain.mapInArrow(_squeeze, "uid long, tag int, text binary")
    rows = plain.mapInArrow(_run_rows(width, gram), _RUN_DDL)
    # pass 1: minimisers that occur more than once
    often = rows.groupBy("h").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 OR any_own")
    live = durable(rows.join(often.select("h", "any_own"), "h").drop("own"))
    # pass 2: equal texts of runs
    place = F.struct("uid", "tag", "a", "b")
    heads = durable(live.groupBy("h", "c").agg(F.min(place).alias("head"), F.max("any_own").alias("any_own")))
    later = live.select("h", "c", "uid", "tag", "a", "b").join(heads.select("h", "c", "head"), ["h", "c"]).filter(place != F.col("head")).select("uid", "tag", "a", "b")
    # pass 3: the first runs whose minimiser has other texts too, by gram and half a window beside it
    deeper = heads.groupBy("h").agg((F.count("*") > 1).alias("several"), F.max("any_own").alias("any_own")).filter("several OR any_own").select("h")
    deep = heads.join(deeper, "h").groupBy("head.uid", "head.tag").agg(F.collect_list(F.struct("h", "head.a", "head.b")).alias("runs"))
    held = base.join(deep, ["uid", "tag"]).select("uid", "tag", "text", "runs")
    pieces = durable(held.mapInArrow(_piece_rows(width, gram), "key long, uid long, tag int, a int, piece binary"))
    # pass 4: whole windows; the pieces of a few keys at a time in groups of bounded size, keys that very many share as rows
    hot = durable(pieces.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > key_limit).select("key"))
    crowded = bool(hot.head(1))  # no such key: the pieces need no join
    few = pieces.join(hot, "key", "left_anti") if crowded else pieces
    groups = max(1, pieces.count() // GROUP)
    few = few.select(F.pmod("key", F.lit(groups)).alias("part"), "key", "uid", "tag", "a", "piece")
    covered = later.unionByName(few.groupBy("part").applyInArrow(_repeats_in(width), "uid long, tag int, a int, b int"))
    if not crowded:
        return base, covered
    many = pieces.join(hot, "key", "left_semi").select("uid", "tag", "a", "piece")
    windows = durable(many.mapInArrow(_window_rows(width), "w1 long, w2 long, uid long, tag int, s int"))
    at = F.struct("uid", "tag", "s")
    firsts = windows.groupBy("w1", "w2").agg(F.min(at).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = windows.join(firsts, ["w1", "w2"]).filter(at != F.col("head")).select("uid", "tag", F.col("s").alias("a"), F.col("s").alias("b"))
    return base, covered.unionByName(again)


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_text: bool = False, key_limit: int = KEY_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes)."""
    base, covered = repeated_runs(docs, width, gram, key_limit)
    spans = covered.groupBy("uid", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    held = base.join(spans, ["uid", "tag"], "left").select("uid", "tag", "text", "spans")
    ddl = "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = held.mapInArrow(_cut(width, keep_text), ddl)
    return out.select(F.when(F.col("uid") != _NULL, F.col("uid")).alias("doc_id"), *out.columns[1:])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return removed(docs)
