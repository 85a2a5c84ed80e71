"""Golden graphs, structural operators and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.graph import Digraph
from arcweave.operators import color, components, kernels, pivot, reach, structure, tarjan, trim
from arcweave.plans.scc import PLANS, scc, stage_stats
from arcweave.sources import generators

TINY = [(0, 2), (1, 0), (1, 2), (1, 3), (2, 0), (3, 2), (3, 4), (4, 1), (4, 3), (5, 6), (6, 5)]
SIX = [(0, 3), (0, 4), (1, 2), (1, 4), (1, 5), (2, 4), (4, 1), (4, 3), (4, 5), (5, 0)]


def graph(spark, edges, n):
    rows = spark.createDataFrame([(u, v, "w") for u, v in edges], "src long, dst long, weight string")
    return Digraph.from_edges(rows, n=n)


def labels(df):
    return [r.scc for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def tiny(spark):
    return graph(spark, TINY, 7).materialise()


@pytest.mark.parametrize("plan", PLANS)
def test_every_plan_on_the_tiny_graph(tiny, plan):
    assert labels(scc(tiny, plan, residual_edges=0)) == [0, 1, 0, 1, 1, 5, 5]


def test_raw_names_are_members(tiny):
    raw = {r.id: r.scc for r in scc(tiny, "max_color", normalise=False, residual_edges=0).collect()}
    assert len({raw[i] for i in (1, 3, 4)}) == 1 and raw[1] in (1, 3, 4)
    with pytest.raises(ValueError):
        scc(tiny, "no such plan")


def test_distributed_supersteps_equal_kernels(spark):
    edges = [*TINY, (2, 5), (7, 0), (8, 7), (6, 9), (9, 10), (3, 3), (1, 3)]
    g = graph(spark, edges, 12).materialise()
    rows = lambda df: sorted(map(tuple, df.collect()))
    roots = spark.range(7, 8)
    assert rows(trim.trim_exhaustive(g)) == rows(trim.trim_exhaustive(g, local_edges=0)) == [(7,), (8,), (9,), (10,), (11,)]
    for direction in ("fw", "bw"):
        assert rows(reach.reach(g, roots, direction, levels=True)) == rows(reach.reach(g, roots, direction, levels=True, local_edges=0))
    for options in ({}, {"rotation": 3}, {"mode": "max"}):
        assert rows(color.color_round(g, **options)) == rows(color.color_round(g, local_edges=0, **options))
    assert rows(color.color_round(g, priority=lambda c: -c).select("id", "decided")) == rows(color.color_round(g, mode="max").select("id", "decided"))


def test_pure_supersteps_give_the_components(tiny):
    assert labels(scc(tiny, "max_color", residual_edges=0, local_edges=0)) == [0, 1, 0, 1, 1, 5, 5]


@pytest.mark.parametrize("plan", ["peel_residual", "weak_split"])
def test_pure_supersteps_find_planted_components(spark, plan):
    truth, src, dst = generators.planted(60, 1.5, 7)
    g = graph(spark, list(zip(src.tolist(), dst.tolist(), strict=True)), 60).materialise()
    assert labels(scc(g, plan, residual_edges=5, local_edges=0, pure=True)) == truth.tolist()


def test_ids_beyond_32_bits(spark):
    big = 2**32
    edges = [(1, 3), (3, 1), (big, big + 2), (big + 2, big)]
    rows = lambda df: sorted(map(tuple, df.collect()))
    ids = spark.createDataFrame([(1,), (3,), (big,), (big + 2,)], "id long")
    g = Digraph.from_edges(spark.createDataFrame(edges, "src long, dst long"), ids)
    for rotation in (0, 1, 31):
        found = rows(color.color_round(g, rotation=rotation))
        assert found == rows(color.color_round(g, rotation=rotation, local_edges=0)) and len(found) == 4
        assert len({r[2] for r in found}) == 2 and all(r[3] for r in found)


def test_vertex_zero_alone(spark):
    g = graph(spark, [(0, 0)], None)
    assert [r.id for r in g.vertices.collect()] == [0] and labels(scc(g)) == [0]
    assert graph(spark, [], None).vertices.count() == 0


def test_one_direction_and_onward_trims(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (5, 5)], 7)
    ids = lambda df: sorted(r.id for r in df.collect())
    for limit in (500_000, 0):
        assert ids(trim.trim_exhaustive(g, local_edges=limit, sides=("in",))) == [0, 6]
        assert ids(trim.trim_exhaustive(g, local_edges=limit, sides=("out",))) == [3, 4, 6]
        assert ids(trim.trim_onward(g, trim.trim_first(g), local_edges=limit)) == [3]


def test_sequential_stage_is_guarded(spark, tiny):
    with pytest.raises(ValueError):
        tarjan.tarjan(tiny, most_edges=5)


def test_long_chain_in_the_color_kernel():
    n = 50_000
    label, decided = kernels.color(np.arange(n - 1), np.arange(1, n), np.arange(n), True)
    assert (label == 0).all() and decided.sum() == 1


def test_stage_counts_add_up(tiny):
    rows = stage_stats(tiny, "peel_rounds", residual_edges=0).collect()
    assert sum(r.decided for r in rows) == 7 and rows[-1].undecided_after == 0 and rows[-1].live_edges_after == 0


def test_six_vertex_layout(spark):
    g = graph(spark, SIX, 6)
    assert [r.off for r in structure.csr_head(g).orderBy("pos").collect()] == [0, 2, 5, 6, 6, 9, 10]
    back = g.transpose()
    assert [r.off for r in structure.csr_head(back).orderBy("pos").collect()] == [0, 1, 2, 3, 5, 8, 10]
    assert [r.v for r in structure.csr_edges(back).orderBy("pos").collect()] == [5, 4, 1, 0, 4, 0, 1, 2, 1, 4]
    sub, names = structure.induced_subgraph(g, spark.createDataFrame([(1,), (2,), (4,)], "id long"), compact=True)
    assert [(r.old, r.new) for r in names.orderBy("old").collect()] == [(1, 0), (2, 1), (4, 2)]
    assert [r.off for r in structure.csr_head(sub).orderBy("pos").collect()] == [0, 2, 3, 4]
    assert [r.v for r in structure.csr_edges(sub).orderBy("pos").collect()] == [1, 2, 2, 0]
    assert [r.off for r in structure.csr_head(sub.transpose()).orderBy("pos").collect()] == [0, 1, 2, 4]
    assert structure.replicate(g).num_rows == 10
    with pytest.raises(ValueError):
        structure.replicate(g, limit=3)


def test_single_edge_and_empty(spark):
    one = graph(spark, [(0, 1)], 2)
    assert [(r.id, r.in_deg, r.out_deg) for r in one.degrees().orderBy("id").collect()] == [(0, 0, 1), (1, 1, 0)]
    empty = graph(spark, [], 0)
    for plan in ("default", "tarjan"):
        assert scc(empty, plan).count() == 0
    assert structure.csr_head(empty).collect()[0].off == 0 and structure.csr_edges(empty).count() == 0
    isolated = graph(spark, [], 4)
    assert labels(scc(isolated, "max_color", residual_edges=0)) == [0, 1, 2, 3]


@pytest.mark.parametrize("plan", ["default", "peel_residual"])
def test_awkward_shapes(spark, plan):
    path = [(i, i + 1) for i in range(200)]
    cycle = [(300 + i, 300 + (i + 1) % 150) for i in range(150)]
    loops = [(210, 210), (211, 212), (211, 212), (212, 211), (299, 300), (200, 300)]
    g = graph(spark, path + cycle + loops, 460).materialise()
    expected = [211 if i in (211, 212) else 300 if 300 <= i < 450 else i for i in range(460)]
    assert labels(scc(g, plan, residual_edges=0)) == expected


def test_trims_and_pivots(spark):
    g = graph(spark, [(0, 0), (1, 2), (2, 1), (2, 3), (4, 4), (4, 5)], 7)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(trim.trim_first(g)) == [3, 5, 6]
    assert ids(trim.trim_normal(g)) == [6]
    assert ids(trim.trim_normal(g, mode="either")) == [0, 3, 4, 5, 6]
    assert ids(trim.trim_exhaustive(g)) == [3, 5, 6]
    assert pivot.select_pivot(g) == 2
    assert pivot.select_pivot(g, undecided=spark.createDataFrame([(4,), (5,), (1,)], "id long"), live=True) == 4
    assert pivot.select_pivot(g, rule="in_degree") == 0
    assert pivot.select_pivot(graph(spark, [], 0)) is None


def test_label_tables(spark, tiny):
    found = scc(tiny)
    assert structure.component_count(found).first().n_scc == 3
    assert {(r.scc, r.size) for r in structure.component_sizes(found).collect()} == {(0, 2), (1, 3), (5, 2)}
    s = structure.scc_summary(found).first()
    assert (s.n_scc, s.largest, s.trivial, s.unassigned) == (3, 3, 0, 0)
    assert {(r.src, r.dst, r.n) for r in structure.condensation(tiny, found).collect()} == {(1, 0, 3)}
    assert sorted(r.id for r in structure.largest_members(found).collect()) == [1, 3, 4]
    assert structure.compare_labels(found, found).count() == 0
    wrong = found.withColumn("scc", F.when(F.col("id") == 6, 6).otherwise(F.col("scc")))
    assert {r.id for r in structure.compare_labels(found, wrong, context=1).collect()} == {5, 6}
    assert {(r.id, r.wcc) for r in components.wcc(tiny).collect()} == {(i, 0 if i < 5 else 5) for i in range(7)}
    assert labels(tarjan.tarjan(tiny, F.col("id") != 1)) == [0, 0, 3, 3, 5, 5]


def test_validate(spark):
    assert graph(spark, TINY, 7).validate() == []
    assert len(graph(spark, TINY, 5).validate()) == 1
    bad = Digraph(spark.createDataFrame([(0,), (2,)], "id long"), spark.createDataFrame([(0, None)], "src long, dst long"))
    assert len(bad.validate()) == 2
