"""Near-duplicate join on word 5-grams: MinHash banding, then exact verification.

Documents with equal text collapse to one row, its digest their key, before anything else, by a grouped
digest that is aggregated before it is shuffled. Each distinct text gets 100 MinHash values in ``BANDS`` = 20 bands of
``ROWS`` = 5: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996. Rows are shuffled on
band hashes. Buckets with the same members in several bands are kept once. A bucket is cut into blocks of about
``BLOCK`` members and ``BLOCK_BYTES`` of text at most and every pair of blocks is one verification task, so no task holds a whole bucket and no pair
is ever a row: a task compares full n-gram sets and returns per-document link counts and
one spanning edge per linked document. A pair that shares several bands is counted in the first of them. Since
every link counts, a bucket of m texts costs m^2 comparisons, and each of its texts travels once per block.

Classes are the connected components of the links (together with equal texts), by minimum labels with pointer jumping.

Result: doc_id, class_id (smallest id of the class), copies (other documents with an equal text), links (other distinct
texts with similarity of at least the threshold).

Edge cases: null text counts as empty; empty texts are copies of each other and link to nothing else; a text of fewer
than five words is one n-gram, its word sequence; very long texts are compared whole; documents without an id take part like
others, and a class of them alone has a null class_id; different texts that share an id are different documents; repeated rows are copies; an empty table
gives an empty result; extra columns of any name are kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import durable, strings, text_or_empty
from arcweave.operators.components import star_components

WORDS = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
BLOCK = 512  # texts
BLOCK_BYTES = 8 << 20  # characters of text
_SEED = 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _coefficients(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    n = bands * rows
    return rng.integers(0, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Word -> 64-bit hash, computed once per word and forgotten when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def grams(text: str, n: int = WORDS, memo: _Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text (empty for a text without words)."""
    memo = _Words() if memo is None else memo
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    m = len(h) - width + 1
    s = np.full(m, width, np.uint64)
    for k in range(width):
        s = s * _M1 + h[k : k + m]
    return np.unique(_mix(s))


def band_keys(g: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    least = np.empty(len(a), np.uint64)
    for j in range(len(a)):
        least[j] = (g * a[j] + b[j]).min()
    m = least.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for r in range(rows):
        key = _mix(key * _M1 + m[:, r])
    return key


def _sign(batches):
    a, b = _coefficients(BANDS, ROWS)
    memo = _Words()
    for batch in batches:
        keys, sizes = [], []
        for text in strings(batch.column(2)):
            g = grams(text, WORDS, memo)
            keys.append(band_keys(g, a, b).view(np.int64).tolist() if len(g) else [])
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["digest", "doc_id", "keys", "size"])


def _verify(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among the members of two blocks of one bucket (or within one)."""
    a, b = _coefficients(BANDS, ROWS)
    memo = _Words()
    band, bi, bj = (int(pdf[c].iloc[0]) for c in ("band", "bi", "bj"))
    pdf = pdf.sort_values("rep")
    ids, side = pdf["rep"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64)
    sets = [grams(t, WORDS, memo) for t in pdf["text"]]
    keys = np.stack([band_keys(g, a, b) for g in sets])
    n = np.array([len(g) for g in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # an n-gram of one member alone is in no intersection
    new = np.cumsum(shared) - 1
    at = shared[column]
    column, owner = new[column[at]], owner[at]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(new[-1]) + 1 if len(new) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[i:j], column[i:j] - lo] = 1
        common += dense @ dense.T
    x, y = np.nonzero(common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6)
    ok = (ids[x] < ids[y]) if bi == bj else (side[x] == 0) & (side[y] == 1)
    x, y = x[ok], y[ok]
    # int64 arithmetic decides exact thresholds
    inter = common[x, y].astype(np.int64)
    ok = inter / (n[x] + n[y] - inter) >= threshold
    x, y = x[ok], y[ok]
    first = (keys[x] == keys[y]).argmax(1) == band
    x, y = x[first], y[first]
    links = np.bincount(np.concatenate([x, y]), minlength=len(ids))
    # one edge to the least partner for each linked member, on both sides: the same components as all links
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, x, ids[y])
    np.minimum.at(least, y, ids[x])
    root = np.arange(len(ids))
    while len(x):  # label the block's own components by their least member
        new_root = root.copy()
        np.minimum.at(new_root, x, root[y])
        np.minimum.at(new_root, y, root[x])
        new_root = new_root[new_root]
        if (new_root == root).all():
            break
        root = new_root
    has = links > 0
    return pd.DataFrame({"rep": ids[has], "links": links[has].astype(np.int64), "to": ids[root[has]]})


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _spot(doc_id: Column, digest: Column) -> Column:
    """One string for an id and a text, as join key: neither shared ids nor many copies of a text make it common."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), digest)


def representatives(docs: DataFrame) -> DataFrame:
    """One row per distinct text, written out: rep (its number), digest, least (smallest id), n (documents), size (characters), keys (band keys)."""
    text = text_or_empty("text")
    signed = docs.select(_digest(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_sign, "digest string, doc_id long, keys array<long>, size long")
    found = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    return durable(found.withColumn("rep", F.monotonically_increasing_id()))  # fixed once written


def link(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(representatives, verified) where verified has rep, links, to: link counts and spanning edges, per task."""
    reps = representatives(docs)
    banded = reps.select("rep", "size", F.posexplode("keys").alias("band", "key"))
    h = F.xxhash64("rep", F.lit(7))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(h).alias("y")).filter("m > 1")
    # the same members in several bands: the earliest bucket stands for all
    buckets = buckets.groupBy("m", "size", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "m", F.col("size").alias("total"))
    members = banded.drop("size").join(buckets, ["band", "key"])
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / block_bytes)).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int")
    members = members.withColumns({"blocks": blocks, "mine": mine})
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("rep", "band", "key", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    asked = pairs.select("rep").distinct().join(reps.select("rep", _spot(F.col("least"), F.col("digest")).alias("spot")), "rep")
    text = text_or_empty("text")
    texts = docs.select(_spot(F.col("doc_id").cast("long"), _digest(text)).alias("spot"), text.alias("text"))
    texts = texts.join(asked, "spot").groupBy("spot", "rep").agg(F.min("text").alias("text")).drop("spot")
    held = pairs.join(texts, "rep")
    out = held.groupBy("band", "key", "bi", "bj").applyInPandas(lambda pdf: _verify(pdf, threshold), "rep long, links long, to long")
    return reps, durable(out)


def groups(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct text: digest, least, n, links, root (the number of its class), class_id."""
    reps, verified = link(docs, threshold, block, block_bytes)
    roots = star_components(verified.select(F.col("rep").alias("src"), F.col("to").alias("dst")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = reps.select("rep", "least").join(roots, F.col("rep") == F.col("id")).select("rep", "least", F.col("component").alias("root"))
    class_of = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = durable(linked.drop("least").join(class_of, "root"))
    rows = reps.select("digest", "rep", "least", "n").join(linked, "rep", "left").join(links, "rep", "left")
    class_id = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id"))
    return rows.select("digest", "least", "n", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("root", "rep").alias("root"), class_id.alias("class_id"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, class_id, copies, links."""
    known = groups(docs, threshold, block, block_bytes).select("digest", "class_id", (F.col("n") - 1).alias("copies"), "links")
    rows = docs.select("doc_id", _digest(text_or_empty("text")).alias("digest"))
    return rows.join(known, "digest").select("doc_id", "class_id", "copies", "links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of every class one document, with its own columns: the one with the smallest id, or with the least digest where no text has an id.

    Of rows that share id and text one stays, the first by a hash of all columns.
    """
    best = groups(docs, threshold).groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "digest")).alias("b"))
    best = best.select(_spot(F.col("b.least"), F.col("b.digest")).alias("spot"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(_spot(F.col("doc_id").cast("long"), _digest(text_or_empty("text"))).alias("spot"), row.alias("row"))
    kept = rows.join(best, "spot", "left_semi").groupBy("spot").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs)
