"""Toxicity by compression distance.

Two separate zstandard dictionaries are trained on labelled text, one on toxic documents and one on ordinary ones.
The whole lower-cased text is cut into windows, every byte in exactly one (a word with the white space before it, at most ``LONGEST``
bytes of each), and each window is compressed under both dictionaries. The pair of lengths is looked up in a table
of log ratios (how much commoner the pair is in toxic than in ordinary text), and a logistic calibration on the sum of these and on
how many windows reach each of several thresholds gives a probability.

A short match costs zstandard about as much as the few letters it replaces, so in text as it is the two lengths differ by noise alone.
Windows and dictionary contents are therefore written with ``WIDE`` bytes for each byte, a fixed one-to-one code that
loses nothing: a matched stretch costs the same as before and what is not matched costs ``WIDE`` times as much, so the length counts
the stretches in which the dictionary covers the window. The ordinary dictionary is trained in ``ROUNDS`` + 1 rounds: each further
round trains on the ordinary windows that the toxic dictionary still compresses better.

Training reads at most ``SAMPLE`` labelled documents of each class and as many of them as start within ``SAMPLE_BYTES``, the first by a
hash of the id, from the rows whose crc32(doc_id as text) mod 5 is not 0. Of every eight, four train the dictionaries, two the
table and two the calibration, weighted back to the shares of the classes among all training labels. Only the text is an input.

Edge cases: null text counts as empty; a text without windows gets the calibrated
score of such documents; very long texts are read to their end; a document labelled twice counts as toxic if any label says so; null
labels are ignored; with no labels of a class the score is the share of the other; repeated rows score alike; an empty
table gives an empty result; extra columns of any name are ignored, or kept by ``keep_clean`` and ``scored``.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import free_name, strings, text_or_empty

SAMPLE = 3000  # documents of a class
SAMPLE_BYTES = 32 << 20  # bytes of a class
LONGEST = 48  # bytes of white space, and of other bytes, to a window
TOXIC_BYTES, ORDINARY_BYTES, FURTHER_BYTES = 65536, 65536, 16384
ROUNDS = 2
WIDE = 3
SHORT = 50  # windows added to every length, so that a few windows say little
THRESHOLDS = (0.25, 0.5, 1.0, 1.5, 2.0, 2.5)
_WINDOW = re.compile(rb"[\x09-\x0d\x20]{0,%d}[^\x09-\x0d\x20]{1,%d}|[\x09-\x0d\x20]{1,%d}" % (LONGEST, LONGEST, LONGEST))
_TOP = 320  # lengths from here on share a cell; two full halves of incompressible bytes stay below
_REPEATS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])  # the last header field of a trained dictionary
_MEMO = 200_000


def _code() -> np.ndarray:
    """One row of ``WIDE`` bytes per byte value; each column is a permutation."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(256) for _ in range(WIDE)], 1).astype(np.uint8)


_CODE = _code()


def widen(data: bytes) -> bytes:
    return _CODE[np.frombuffer(data, np.uint8)].tobytes()


def windows(text: str) -> list[bytes]:
    """The text's bytes in order, cut into windows."""
    return _WINDOW.findall(text.lower().encode("utf-8", "surrogatepass"))


def _trained(pieces: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on stretches of 40 windows (their end, where there are too few to train on)."""
    samples = [b"".join(pieces[i : i + 40]) for i in range(0, len(pieces), 40)]
    random.Random(3).shuffle(samples)
    try:
        whole = zstandard.train_dictionary(size, samples, k=32, d=8, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    at = whole.find(_REPEATS)
    return whole[at + len(_REPEATS) :] if at >= 0 else whole


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(window_log=20, hash_log=18, chain_log=18, search_log=8, min_match=6, target_length=256, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
    if not content:
        return zstandard.ZstdCompressor(compression_params=p)
    d = zstandard.ZstdCompressionDict(widen(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


class Lengths(dict):
    """Window -> cell of its two compressed lengths, toxic * _TOP + ordinary; computed once per window, forgotten when large."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def __missing__(self, window: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        wide = widen(window)
        cell = self[window] = min(len(self.toxic.compress(wide)), _TOP - 1) * _TOP + min(len(self.ordinary.compress(wide)), _TOP - 1)
        return cell

    def of(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


@dataclass
class Model:
    """Dictionaries' contents, table and calibration; ``constant`` where a class had no labels."""

    toxic: bytes = b""
    ordinary: bytes = b""
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted cells seen in training
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    centre: tuple = ()
    scale: tuple = ()
    beta: tuple = ()
    constant: float | None = None

    def lengths(self) -> Lengths:
        return Lengths(self.toxic, self.ordinary)

    def scorer(self):
        """text -> probability; builds the compressors once."""
        if self.constant is not None:
            return lambda text: self.constant
        lengths = self.lengths()
        centre, scale, beta = (np.array(x) for x in (self.centre, self.scale, self.beta))

        def score(text: str) -> float:
            z = float(((self.features(text, lengths) - centre) / scale) @ beta)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score

    def ratio_of(self, cells: np.ndarray) -> np.ndarray:
        """Log ratio of each cell, 0 for one that training never saw."""
        if not len(self.cells):
            return np.zeros(len(cells))
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.where(self.cells[at] == cells, self.ratios[at], 0.0)

    def features(self, text: str, lengths: Lengths) -> np.ndarray:
        pieces = windows(text)
        v, n = self.ratio_of(lengths.of(pieces)), len(pieces) + SHORT
        total = float(v.sum())
        return np.array([1.0, math.log(n), total / math.sqrt(n), total / n, total / 10, *(math.log1p(float((v >= t).sum())) for t in THRESHOLDS)])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    beta, w = np.zeros(x.shape[1]), w / w.sum()
    ridge = 1e-3 * np.eye(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * mu * (1 - mu))[:, None]).T @ x + ridge
        beta = beta - np.clip(np.linalg.solve(hess, x.T @ (w * (mu - y)) + ridge @ beta), -5, 5)
    return beta


def _ratios(toxic: np.ndarray, ordinary: np.ndarray, smooth: float = 3.0, most: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Cells, and the log of how much commoner each is among the toxic cells, smoothed and bounded."""
    cells, which = np.unique(np.concatenate([toxic, ordinary]), return_inverse=True)
    t, o = (np.bincount(w, minlength=len(cells)) for w in (which[: len(toxic)], which[len(toxic) :]))
    ratio = np.log((t + smooth) / max(1, len(toxic))) - np.log((o + smooth) / max(1, len(ordinary)))
    return cells, np.clip(ratio, -most, most)


def fit(toxic: list[str], ordinary: list[str], totals: tuple[int, int]) -> Model:
    """``totals``: toxic and ordinary labels in the whole training part."""
    if not toxic or not ordinary:
        return Model(constant=1.0 if toxic else 0.0)
    part = lambda rows, a, b: [t for i, t in enumerate(rows) if a <= i % 8 < b] or rows
    cut = lambda rows: [w for t in rows for w in windows(t)]
    model = Model(_trained(cut(part(toxic, 0, 4)), TOXIC_BYTES), _trained(cut(part(ordinary, 0, 4)), ORDINARY_BYTES))
    plain = cut(part(ordinary, 0, 6))
    for _ in range(ROUNDS):
        cells = model.lengths().of(plain)
        hard = [w for w, better in zip(plain, cells % _TOP - cells // _TOP >= WIDE + 1, strict=True) if better]
        model.ordinary = _trained(hard, FURTHER_BYTES) + model.ordinary
    lengths = model.lengths()
    model.cells, model.ratios = _ratios(*(lengths.of(cut(part(rows, 4, 6))) for rows in (toxic, ordinary)))
    ct, co = part(toxic, 6, 8), part(ordinary, 6, 8)
    x = np.array([model.features(d, lengths) for d in ct + co])
    y = np.array([1.0] * len(ct) + [0.0] * len(co))
    w = np.where(y == 1, totals[0] / len(ct), totals[1] / len(co))
    centre, scale = x.mean(0), x.std(0) + 1e-9
    centre[0], scale[0] = 0, 1
    model.centre, model.scale = tuple(centre.tolist()), tuple(scale.tolist())
    model.beta = tuple(_logistic((x - centre) / scale, y, w).tolist())
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents of each class, those that start within ``sample_bytes``."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("mark")).filter("id IS NOT NULL AND mark IS NOT NULL").filter(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("mark").alias("mark"))
    totals = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    ids = [marks.filter(F.col("mark") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (1, 0)]
    chosen = ids[0].unionByName(ids[1])  # at most 2 * sample ids
    texts = docs.select(F.col("doc_id").alias("own"), text_or_empty("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("own") == F.col("id")).groupBy("id", "mark").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("mark").orderBy(F.xxhash64("id"), "id")) - F.octet_length("text")
    rows = rows.withColumn("before", before).filter(F.col("before") < sample_bytes).orderBy(F.xxhash64("id"), "id").select("mark", "text").collect()
    by = {y: [r["text"] for r in rows if r["mark"] == y] for y in (0, 1)}
    return fit(by[1], by[0], (totals.get(1, 0), totals.get(0, 0)))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a probability of toxicity in the new column ``out``."""

    def run(batches):
        score = model.scorer()
        for b in batches:
            column = pa.array([score(t or "") for t in strings(b.column(text_col))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, out])

    ddl = type(docs.schema)([*docs.schema.fields]).add(out, "double")
    return docs.mapInArrow(run, ddl)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    out = free_name(docs, "toxicity")
    return scored(docs, model, out=out).filter(F.col(out) < threshold).drop(out)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")), learn(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
