"""Reachability and forward-backward search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.durable import durable
from arcweave.graph import Digraph
from arcweave.operators import kernels
from arcweave.operators.trim import LOCAL_EDGES, live_edges


def reach(g: Digraph, roots: DataFrame, direction: str = "fw", within: DataFrame | None = None, levels: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Vertices that ``roots(id)`` reach (``fw``) or that reach them (``bw``), the roots included: id[, level].

    Supersteps join the frontier alone with the edges; a kernel takes over for few edges.
    """
    roots = roots.select(F.col("id").cast("long").alias("id")).distinct()
    if within is not None:
        roots = roots.join(within.select("id"), "id", "left_semi")
    edges = live_edges(g.edges, within)
    if direction == "bw":
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if kernels.fits(edges, local_edges):
        marked = edges.unionByName(roots.select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst")))

        def run(src, dst):
            ids, a, b = kernels.compact(src, dst)
            level = kernels.bfs(len(ids), a, b, a[src == -1][:1]) if (src == -1).any() else a[:0] - 1
            hit = (level > 0) if len(level) else level.astype(bool)
            return {"id": ids[hit], "level": level[hit] - 1} if len(level) else {"id": ids[:0], "level": ids[:0]}

        out = kernels.one_task(marked, run, "id long, level long")
        return out if levels else out.select("id")
    edges = durable(edges.distinct())
    seen = durable(roots.withColumn("level", F.lit(0).cast("long")))
    front, depth = seen, 0
    parts = [seen]
    while front.head(1):
        depth += 1
        front = edges.join(front.select("id"), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        for p in parts:
            front = front.join(p.select("id"), "id", "left_anti")
        front = durable(front.withColumn("level", F.lit(depth).cast("long")))
        parts.append(front)
        if len(parts) > 8:  # many small visited parts cost a join each
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            parts = [durable(whole)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if levels else out.select("id")


def forward_backward(g: Digraph, pivot: int, undecided: DataFrame | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The pivot's strong component: id, scc (the pivot). Backward search stays inside what the forward search reached."""
    root = g.spark.range(pivot, pivot + 1)
    forward = durable(reach(g, root, "fw", undecided, local_edges=local_edges))
    backward = reach(g, root, "bw", forward, local_edges=local_edges)
    return backward.select("id", F.lit(pivot).cast("long").alias("scc"))
