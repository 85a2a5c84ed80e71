"""Exact top-k inner-product search with KD-trees per shard.

Vectors are integers, floor(1024 x). Median splits on the widest dimension, fitted on at most ``SAMPLE_ROWS`` vectors, cut the space
into cells of about ``SHARD_ROWS`` rows; every row is put into its cell, and a cell that holds more (a very common vector, a part of the
space that the sample missed) is dealt into several shards by hash. Each shard builds one tree by median splits on its
widest dimension, with tight bounding boxes. A query walks a tree best first:
the next node is the one whose box allows the highest inner product, sum(max(q lo, q hi)), and the walk ends when that
bound is below the k-th best score so far. Queries visit their home shard first. Then blocks of queries meet the
root boxes alone (one row a shard, in groups of ``BOXES``), and only the (query, shard) pairs whose bound reaches the k-th score found at home
go on; that score goes with them and prunes the other trees.

A shard's candidates travel once per ``BLOCK`` queries that reach it, so every task's input is bounded, whatever the table.
Equal vectors split by position, so a very common vector cannot stall a split.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an
id; vectors of different length never meet; repeated rows with one id count once (the smallest vector
stands for the id); ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
Components and scores beyond the range of a long become its ends (equal scores then, ranked by id); all others are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import durable

K = 10
SHARD_ROWS = 8192
BLOCK = 4096
BOXES = 4096
SAMPLE_ROWS = 16_384  # vectors that the splits are fitted on; at least 8 to a cell
LEAF = 256
_OUT = "query_id long, vec_id long, score long"
_TOP = 2**63 - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v array<long>: the rows that take part, once per id."""
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def splits(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) per node of a complete tree: rows with x[axis] >= cut go right; node i's children are 2i + 1 and 2i + 2."""
    axis, cut, parts = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1, np.int64), {0: x}
    for i in range(2**levels - 1):
        part = parts.pop(i)
        if len(part) and part.shape[1]:
            axis[i] = np.argmax(part.max(0).astype(float) - part.min(0))
            cut[i] = np.sort(part[:, axis[i]])[len(part) // 2]
        right = part[:, axis[i]] >= cut[i] if part.shape[1] else np.zeros(len(part), bool)
        parts[2 * i + 1], parts[2 * i + 2] = part[~right], part[right]
    return axis, cut


def cell_of(x: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[rows, axis[node]] >= cut[node])
    return node


def exact_type(x: np.ndarray, q: np.ndarray):
    """float64 while every partial sum is below 2^53, then int64, then Python integers."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float64 if top < 2**53 else np.int64 if top < 2**62 else object


def _in_range(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -_TOP - 1, _TOP) if scores.dtype == object else scores


class Tree:
    """Arrays ``lo``, ``hi`` (boxes), ``left``/``right`` (children, -1: leaf) and ``rows`` (slices of ``order``)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.lo, self.hi, self.kids, self.rows = [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = x[order[a:b]]
            node = len(self.lo)
            self.lo.append(part.min(0))
            self.hi.append(part.max(0))
            self.kids.append([-1, -1])
            self.rows.append((a, b))
            if parent >= 0:
                self.kids[parent][side] = node
            if b - a > leaf:
                axis = int(np.argmax(self.hi[-1] - self.lo[-1])) if x.shape[1] else 0
                mid = (b - a) // 2
                if x.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.ids, self.x = ids[order], x[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, q: np.ndarray, nodes) -> np.ndarray:
        return _in_range(np.maximum(q * self.lo[nodes], q * self.hi[nodes]).sum(-1))

    def search(self, q: np.ndarray, own: int, k: int, floor_score=None) -> list[tuple[int, int]]:
        """The best k as (score, id), ties to the smaller id; none below ``floor_score``."""
        found: list[tuple] = []  # heap of (score, -id), worst first
        heap = [(-self.bounds(q, [0])[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kth = found[0][0] if len(found) == k else floor_score
            if kth is not None and -bound < kth:
                break
            left, right = self.kids[node]
            if left >= 0:
                for b, child in zip(self.bounds(q, [left, right]), (left, right), strict=True):
                    heapq.heappush(heap, (-b, child))
                continue
            a, z = self.rows[node]
            scores = _in_range(self.x[a:z] @ q)
            ids = self.ids[a:z]
            keep = ids != own
            if kth is not None:
                keep &= scores >= kth
            scores, ids = scores[keep], ids[keep]
            if len(scores) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                scores, ids = scores[scores >= cut], ids[scores >= cut]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                item = (s, -i)
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
        return [(int(s), -i) for s, i in sorted(found, reverse=True)]


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("vec_id")
    return pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.int64) if len(pdf) else np.zeros((0, 0), np.int64)


def _search_all(cands: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(cands) and len(queries):
        ids, x = _arrays(cands)
        qs = np.stack(queries["v"].to_list()).astype(np.int64)
        kind = exact_type(x, qs)
        tree, qs = Tree(ids, x.astype(kind)), qs.astype(kind)
        floors = queries["kth"].tolist() if "kth" in queries else [None] * len(queries)
        for qid, q, kth in zip(queries["vec_id"].tolist(), qs, floors, strict=True):
            out += [(qid, i, s) for s, i in tree.search(q, qid, k, None if kth is None or pd.isna(kth) else int(kth))]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _reachable(boxes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(vec_id, shard, part): the shards, other than its home, whose box allows a query its k-th score."""
    out = []
    if len(boxes) and len(queries):
        lo, hi = (np.stack(boxes[c].to_list()).astype(float) for c in ("lo", "hi"))
        shard, part = boxes["shard"].to_numpy(), boxes["part"].to_numpy()
        for at in range(0, len(queries), 512):
            some = queries.iloc[at : at + 512]
            q = np.stack(some["v"].to_list()).astype(float)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            bound = up @ hi.T + down @ lo.T
            bound += 1e-9 * (up @ np.abs(hi).T - down @ np.abs(lo).T) + 1  # above any rounding
            kth = some["kth"].to_numpy(float, na_value=-np.inf)
            away = (some["shard"].to_numpy()[:, None] != shard) | (some["part"].to_numpy()[:, None] != part)
            i, j = np.nonzero(away & (bound >= kth[:, None]))
            out.append(pd.DataFrame({"vec_id": some["vec_id"].to_numpy()[i], "shard": shard[j], "part": part[j]}))
    return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "shard": [], "part": []}).astype("int64")


def _place(rows: DataFrame, shard_rows: int, sample_rows: int) -> DataFrame:
    """``rows`` with shard (cell) and part."""
    totals = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    sample = rows.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    trees = {}
    for dim, own in sample.groupby("dim"):
        x = np.stack(own["v"].to_list()).astype(np.int64)
        levels = max(0, min(-(-totals[dim] // shard_rows) - 1, len(x) // 8)).bit_length()
        trees[int(dim)] = splits(x, levels)

    def run(batches):
        for pdf in batches:
            pdf["shard"] = 0
            for dim, own in pdf.groupby("dim"):
                if int(dim) in trees and dim:
                    pdf.loc[own.index, "shard"] = cell_of(np.stack(own["v"].to_list()).astype(np.int64), *trees[int(dim)])
            yield pdf

    cells = durable(rows.mapInPandas(run, "vec_id long, v array<long>, dim int, is_query boolean, shard long"))
    parts = cells.groupBy("dim", "shard").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    # at most sample_rows / 8 cells, and one for every length of vector that the sample has not
    return cells.join(parts, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("parts"))).drop("parts")


def top_k(vectors: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS, block: int = BLOCK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that the column ``is_query`` marks."""
    rows = durable(quantised(vectors).withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    rows = durable(_place(rows, shard_rows, sample_rows))
    shard = ["dim", "shard", "part"]

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        """Results within the shard, and a row with its box."""
        found = _search_all(pdf, pdf[pdf["is_query"]], k)
        x = _arrays(pdf)[1]
        ends = [[None] * len(found) + [e.tolist()] for e in (x.min(0), x.max(0))]
        out = {c: pd.array([*found[c], None], "Int64") for c in found}
        return pd.DataFrame(out | {c: int(pdf[c].iloc[0]) for c in shard} | {c: pd.Series(e, dtype=object) for c, e in zip(("lo", "hi"), ends, strict=True)})

    first = durable(rows.groupBy(*shard).applyInPandas(home, _OUT + ", dim int, shard long, part long, lo array<long>, hi array<long>"))
    found, boxes = first.filter("query_id IS NOT NULL").select("query_id", "vec_id", "score"), first.filter("query_id IS NULL").select(*shard, "lo", "hi")
    kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select("query_id", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    queries = rows.filter("is_query").join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "kth", *shard)
    # blocks of queries against groups of boxes
    blocks, groups = max(1, -(-rows.filter("is_query").count() // block)), max(1, -(-boxes.count() // BOXES))
    deal = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.withColumn("block", deal(blocks, F.col("vec_id"), F.lit(1))).withColumn("boxes", every(groups))
    offered = boxes.withColumn("boxes", deal(groups, F.col("shard"), F.col("part"))).withColumn("block", every(blocks))
    meet = ["dim", "block", "boxes"]
    reach = lambda b, q: _reachable(b, q).assign(dim=(q if len(q) else b)["dim"].iloc[0])
    pairs = durable(offered.groupBy(*meet).cogroup(asked.groupBy(*meet)).applyInPandas(reach, "vec_id long, shard long, part long, dim int"))
    # the pairs that are left, in blocks for each shard
    wanted = pairs.groupBy(*shard).agg(F.ceil(F.count("*") / block).alias("blocks"))
    visits = pairs.join(wanted, shard).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select("vec_id", *shard, "block")
    visits = visits.join(queries.select("vec_id", "v", "kth"), "vec_id").select("vec_id", "v", "kth", *shard, "block")
    cands = rows.select("vec_id", "v", *shard).join(wanted, shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def away(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _search_all(c, q, k)

    keys = [*shard, "block"]
    # dealt by block too, or all blocks of a shard would follow it into one task; the visits get names of their own beside the candidates'
    cands, visits = cands.repartition(*keys), visits.select(*[F.col(c).alias(c) for c in visits.columns]).repartition(*keys)
    found = found.unionByName(cands.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(away, _OUT))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), F.col("vec_id").alias("i")))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best"))  # at most k rows per query and shard
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).cast("long").alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's queries: every row whose vec_id is divisible by 100."""
    return top_k(vectors, F.col("vec_id") % 100 == 0)
