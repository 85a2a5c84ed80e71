"""Sequential strong components as one Arrow task, or one task per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.graph import Digraph
from arcweave.operators import kernels


def _label(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    ids, a, b = kernels.compact(src, dst)
    return {"id": ids, "scc": ids[kernels.tarjan(len(ids), a, b)]}


MOST_EDGES = 20_000_000  # of a sequential task


def tarjan(g: Digraph, vertex_filter: Column | None = None, most_edges: int = MOST_EDGES) -> DataFrame:
    """id, scc (least member) for the vertices that pass ``vertex_filter`` (a condition on ``id``), over the edges between them.

    All edges go to one task: for graphs, or what is left of them, that fit one executor. More than ``most_edges`` raise ValueError.
    """
    vertices, edges = g.vertices, g.edges
    if vertex_filter is not None:
        vertices = vertices.filter(vertex_filter)
        edges = edges.join(vertices, F.col("src") == F.col("id"), "left_semi").join(vertices, F.col("dst") == F.col("id"), "left_semi")
    edges = edges.filter("src <> dst").distinct()
    if not kernels.fits(edges, most_edges):
        raise ValueError(f"more than {most_edges} edges for one task; use a plan of supersteps")
    found = kernels.one_task(edges, _label, "id long, scc long")
    return vertices.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def within(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """src, dst, _g: the distinct edges whose ends share a group."""
    a = vertices.select(F.col("id").alias("src"), F.col(group).alias("_g"))
    b = vertices.select(F.col("id").alias("dst"), F.col(group).alias("_h"))
    return edges.filter("src <> dst").distinct().join(a, "src").join(b, "dst").filter("_g = _h").select("src", "dst", "_g")


def tarjan_by_group(vertices: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Strong components inside groups, one task per group: ``vertices`` (id, group), edges between groups ignored.

    A group must fit one executor; ``within`` finds the edges of each group, so a caller can leave out larger ones.
    """
    inner = within(vertices, edges, group)

    def run(table: pa.Table) -> pa.Table:
        out = _label(table.column("src").to_numpy(), table.column("dst").to_numpy())
        return pa.table({k: pa.array(v) for k, v in out.items()})

    found = inner.select("src", "dst", "_g").groupBy("_g").applyInArrow(run, "id long, scc long")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
