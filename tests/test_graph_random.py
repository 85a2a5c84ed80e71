"""Planted components, random graphs and the driver's fixtures."""

import numpy as np
import pytest

from arcweave.graph import Digraph
from arcweave.operators import kernels
from arcweave.plans.scc import PLANS, scc
from arcweave.sources import generators


def planted_cases():
    rng = np.random.default_rng(3)
    for n in range(1, 50):
        yield n, float(rng.uniform(0, 3)), n
    for n in range(1, 47, 5):
        for d in np.arange(0, 3.25, 0.7):
            yield n, float(d), 1000 + n
    for i in range(99):
        yield int(rng.integers(50, 401)), float(rng.uniform(0, 7)), 2000 + i


def test_kernel_finds_planted_components_and_their_transpose():
    for n, d, seed in planted_cases():
        truth, src, dst = generators.planted(n, d, seed)
        assert (kernels.tarjan(n, src, dst) == truth).all() and (kernels.tarjan(n, dst, src) == truth).all()
        assert (src != dst).all() and len(set(zip(src.tolist(), dst.tolist(), strict=True))) == len(src)


def brute_peel(n, edges):
    gone = set()
    for side in (0, 1):
        while True:
            live = [e for e in edges if e[0] not in gone and e[1] not in gone]
            new = {v for v in range(n) if v not in gone and all(e[1 - side] != v for e in live)}
            if not new:
                break
            gone |= new
    return [v in gone for v in range(n)]


def test_peel_kernel():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = int(rng.integers(1, 25))
        edges = rng.integers(n, size=(int(rng.integers(0, 2 * n)), 2))
        assert kernels.peel(n, edges[:, 0], edges[:, 1]).tolist() == brute_peel(n, edges.tolist())


def test_color_kernel_closed_form():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 15))
        edges = rng.integers(n, size=(int(rng.integers(0, 2 * n)), 2))
        src, dst = edges[:, 0], edges[:, 1]
        reaches = np.array([kernels.bfs(n, src, dst, np.array([v])) >= 0 for v in range(n)])
        key = rng.permutation(n)
        label, decided = kernels.color(src, dst, key, True)
        owner = np.argsort(key)
        for v in range(n):
            least = min(key[u] for u in range(n) if reaches[u][v])
            assert label[v] == least and decided[v] == reaches[v][owner[least]]


@pytest.mark.parametrize("partitions", [3, 1, 7])
def test_plans_on_planted_graphs(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n, plan = {3: (16, "peel_light_residual"), 1: (33, "weak_split"), 7: (64, "color_rounds")}[partitions]
        g, truth = generators.planted_graph(spark, n, 1.5, n + partitions)
        found = scc(g.materialise(), plan, residual_edges=0)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, truth.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 3)


@pytest.mark.parametrize("fixture,count,largest", [("g_giant", 124, 73), ("g_brand", 171, 9), ("g_type", 15, 36), ("g_size8", 47, 28)])
def test_fixture_components(spark, sf_dir, fixture, count, largest):
    g = Digraph.from_tables(spark, sf_dir, fixture)
    sizes = [r["count"] for r in scc(g).groupBy("scc").count().collect()]
    assert (len(sizes), max(sizes)) == (count, largest)


def test_residual_cut_over(spark):
    g, truth = generators.planted_graph(spark, 80, 2.0, 9)
    for plan, limit in (("default", 5), ("peel_residual", 500_000)):
        assert sorted(map(tuple, scc(g, plan, residual_edges=limit).collect())) == sorted(map(tuple, truth.collect()))
    assert len(PLANS) == 11


@pytest.mark.parametrize("text,n,m", [("gnm-directed;n=463;m=463;seed=13", 463, 463), ("rmat;directed;n=463;m=1243;a=.59;b=.19;c=.19;seed=13", 463, 1243), ("rmat;directed;N=8;M=9;a=.25;b=.25;c=.25", 256, 512)])
def test_generators(spark, text, n, m):
    g = generators.generate(spark, text)
    edges = g.edges.collect()
    assert g.vertices.count() == n and len(edges) == m == len({(e.src, e.dst) for e in edges})
    assert all(e.src != e.dst and 0 <= e.src < n and 0 <= e.dst < n for e in edges)
    again = generators.generate(spark, text).edges.collect()
    assert sorted(map(tuple, edges)) == sorted(map(tuple, again))
    with pytest.raises(ValueError):
        generators.generate(spark, "ring;n=4;m=4")
