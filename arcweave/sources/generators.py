"""Synthetic graphs: uniform, recursive-matrix, and planted components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.graph import Digraph
from arcweave.operators.structure import numbered


def _unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / float(1 << 53)


def _first_distinct(draws: DataFrame, m: int) -> DataFrame:
    """The first m distinct edges in the order of their earliest draw."""
    once = draws.filter("src <> dst").groupBy("src", "dst").agg(F.min("i").alias("i"))
    return numbered(once, ["i"]).filter(F.col("pos") < m).select("src", "dst")


def _generate(spark: SparkSession, n: int, m: int, draw) -> Digraph:
    if m > n * (n - 1):
        raise ValueError("more edges than a simple graph on n vertices has")
    count = m + m // 8 + 16
    while True:
        draws = draw(spark.range(count).withColumnRenamed("id", "i"))
        if draws.filter("src <> dst").select("src", "dst").distinct().count() >= m:
            return Digraph(spark.range(n), _first_distinct(draws, m))
        count *= 2


def gnm(spark: SparkSession, n: int, m: int, seed: int = 13) -> Digraph:
    """m distinct directed edges, uniform, no self-loops; the seed decides."""
    pick = lambda k: F.least(F.floor(_unit(seed, F.col("i"), F.lit(k)) * n), F.lit(n - 1)).cast("long")
    return _generate(spark, n, m, lambda i: i.select("i", pick(0).alias("src"), pick(1).alias("dst")))


def rmat(spark: SparkSession, n: int, m: int, a: float = 0.59, b: float = 0.19, c: float = 0.19, seed: int = 13) -> Digraph:
    """m distinct edges by recursive quadrant choice with probabilities a, b, c and the rest; no self-loops."""
    scale = max(1, math.ceil(math.log2(max(2, n))))

    def draw(i: DataFrame) -> DataFrame:
        src = dst = F.lit(0).cast("long")
        for level in range(scale):
            x = _unit(seed, F.col("i"), F.lit(level))
            src = src * 2 + (x >= a + b).cast("long")
            dst = dst * 2 + (((x >= a) & (x < a + b)) | (x >= a + b + c)).cast("long")
        return i.select("i", src.alias("src"), dst.alias("dst")).filter((F.col("src") < n) & (F.col("dst") < n))

    return _generate(spark, n, m, draw)


def planted(n: int, d: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component of each vertex, src, dst) with known components, for tests; n up to about 10^5.

    Vertices open a component with probability 1/4 or join one; members form a shuffled cycle; further edges
    run inside a component or to one with a smaller name, until the average degree is d (clamped to what is sensible).
    No self-loops, no parallel edges; components are named by their least member.
    """
    rng = np.random.default_rng(seed)
    comp = np.zeros(n, np.int64)
    names: list[int] = []
    for v in range(n):
        if not names or rng.random() < 0.25:
            names.append(v)
            comp[v] = v
        else:
            comp[v] = names[rng.integers(len(names))]
    edges: set[tuple[int, int]] = set()
    for c in names:
        members = rng.permutation(np.flatnonzero(comp == c))
        if len(members) > 1:
            edges.update(zip(members.tolist(), np.roll(members, -1).tolist(), strict=True))
    low = math.log(max(1.0, math.log(max(1, n)))) if n else 0.0
    goal = int(min(max(d, low), max(0.0, (n - 1) / 2)) * n)
    for _ in range(20 * max(goal, 1)):
        if len(edges) >= goal or n < 2:
            break
        u, v = (int(x) for x in rng.integers(n, size=2))
        if comp[u] < comp[v]:
            u, v = v, u
        if u != v:
            edges.add((u, v))
    pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
    return comp, pairs[:, 0], pairs[:, 1]


def planted_graph(spark: SparkSession, n: int, d: float, seed: int) -> tuple[Digraph, DataFrame]:
    """(graph, true labels)."""
    comp, src, dst = planted(n, d, seed)
    edges = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), strict=True)), "src long, dst long")
    return Digraph.from_edges(edges, n=n), spark.createDataFrame(list(enumerate(comp.tolist())), "id long, scc long")


def generate(spark: SparkSession, options: str) -> Digraph:
    """From an option string: ``gnm-directed;n=..;m=..;seed=..`` or ``rmat;directed;n=..;m=..;a=..;b=..;c=..;seed=..``; N and M are base-2 logarithms."""
    kind, *parts = options.split(";")
    kv = dict(p.split("=") for p in parts if "=" in p)
    n = int(kv["n"]) if "n" in kv else 1 << int(kv["N"])
    m = int(kv["m"]) if "m" in kv else 1 << int(kv["M"])
    seed = int(kv.get("seed", 13))
    if kind == "gnm-directed":
        return gnm(spark, n, m, seed)
    if kind == "rmat":
        return rmat(spark, n, m, *(float(kv.get(k, d)) for k, d in (("a", 0.59), ("b", 0.19), ("c", 0.19))), seed)
    raise ValueError(f"unknown generator {kind}")
