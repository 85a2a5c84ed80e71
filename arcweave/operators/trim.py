"""Trimming: vertices that cannot lie on a cycle are components of their own. Each operator returns (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.durable import durable
from arcweave.graph import Digraph
from arcweave.operators import kernels

LOCAL_EDGES = 500_000


def live_edges(edges: DataFrame, undecided: DataFrame | None) -> DataFrame:
    """Edges with both ends undecided."""
    if undecided is None:
        return edges
    u = undecided.select("id")
    return edges.join(u, F.col("src") == F.col("id"), "left_semi").join(u, F.col("dst") == F.col("id"), "left_semi")


def trim_first(g: Digraph) -> DataFrame:
    """Vertices with no edge in or no edge out; a self-loop counts as both."""
    return g.degrees().filter("in_deg = 0 OR out_deg = 0").select("id")


def trim_normal(g: Digraph, undecided: DataFrame | None = None, mode: str = "both") -> DataFrame:
    """One snapshot sweep over the undecided vertices.

    ``both``: no live neighbour in either direction (a self-loop is one). ``either``: none in at least one
    direction, self-loops aside.
    """
    undecided = (g.vertices if undecided is None else undecided).select("id")
    live = live_edges(g.edges, undecided)
    if mode == "both":
        ends = live.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return undecided.join(ends, "id", "left_anti")
    live = live.filter("src <> dst")
    outs, ins = live.select(F.col("src").alias("id")).distinct(), live.select(F.col("dst").alias("id")).distinct()
    return undecided.join(outs.join(ins, "id", "left_semi"), "id", "left_anti")


def _peel_side(vertices: DataFrame, edges: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Vertices without incoming edges, to a fixpoint; each superstep joins only the newly decided ones."""
    live = vertices if gone is None else vertices.join(gone, "id", "left_anti")
    edges = durable(live_edges(edges, None if gone is None else live))
    degree = live.join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    degree = durable(degree)
    found, new = [], durable(degree.filter("d = 0").select("id"))
    while new.head(1):
        found.append(new)
        degree = degree.filter("d > 0")
        lost = edges.join(new, F.col("src") == F.col("id")).groupBy("dst").agg(F.count("*").alias("k"))
        degree = durable(degree.join(lost, F.col("id") == F.col("dst"), "left").select("id", (F.col("d") - F.coalesce("k", F.lit(0))).alias("d")))
        new = durable(degree.filter("d = 0").select("id"))
    out = vertices.limit(0)
    for f in found:
        out = out.unionByName(f)
    return durable(out)


def trim_exhaustive(g: Digraph, undecided: DataFrame | None = None, local_edges: int = LOCAL_EDGES, sides: tuple[str, ...] = ("in", "out")) -> DataFrame:
    """Peel sources to a fixpoint (``in``), then sinks (``out``), among the undecided vertices; ``sides`` may name one of the two."""
    vertices = (g.vertices if undecided is None else undecided).select("id")
    edges = live_edges(g.edges, undecided)
    if kernels.fits(edges, local_edges):

        def stay(src, dst):
            ids, a, b = kernels.compact(src, dst)
            return {"id": ids[~kernels.peel(len(ids), a, b, sides)]}

        return vertices.join(kernels.one_task(edges, stay, "id long"), "id", "left_anti")
    gone = None
    for side in sides:
        new = _peel_side(vertices, edges if side == "in" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), gone)
        gone = new if gone is None else gone.unionByName(new)
    return gone


def trim_onward(g: Digraph, decided: DataFrame, undecided: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """What follows once ``decided(id)`` has left: sources to a fixpoint, then sinks, among the other undecided vertices."""
    vertices = (g.vertices if undecided is None else undecided).select("id")
    return trim_exhaustive(g, vertices.join(decided.select("id"), "id", "left_anti"), local_edges)


def live_degrees(g: Digraph, undecided: DataFrame) -> DataFrame:
    """id, in_deg, out_deg among the undecided vertices."""
    return Digraph(undecided.select("id"), live_edges(g.edges, undecided)).degrees()
