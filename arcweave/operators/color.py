"""Colouring rounds: least (or greatest) priority that reaches a vertex, then the components of the winners."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.durable import durable
from arcweave.functions.idmath import MASK32, rotr32
from arcweave.graph import Digraph
from arcweave.operators import kernels
from arcweave.operators.trim import LOCAL_EDGES, live_edges


def _rotate(ids: np.ndarray, r: int) -> np.ndarray:
    r %= 32
    low = ids & MASK32
    return (ids & ~MASK32) | (low >> r) | ((low << (32 - r)) & MASK32) if r else ids


def color_round(g: Digraph, undecided: DataFrame | None = None, priority: Callable[[Column], Column] | None = None, rotation: int = 0, mode: str = "min", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """One round over the undecided vertices: id, label, seed (the label's owner), decided.

    label(v) is the least (``min``) or greatest (``max``) priority among the vertices that reach v; v is
    decided if it also reaches that vertex, and then lies in its component. ``priority`` must be injective; the default rotates
    the low 32 bits of ids by ``rotation``. A label only travels while it improves, so work follows the changes.
    """
    vertices = (g.vertices if undecided is None else undecided).select("id")
    edges = live_edges(g.edges, undecided).filter("src <> dst")
    key = priority or (lambda c: rotr32(c, rotation))
    if priority is None and kernels.fits(edges, local_edges):

        def run(src, dst):
            ids, a, b = kernels.compact(src, dst)
            k = _rotate(ids, rotation)
            label, decided = kernels.color(a, b, k, mode == "min")
            order = np.argsort(k)
            return {"id": ids, "label": label, "seed": ids[order[np.searchsorted(k[order], label)]], "decided": decided}

        found = kernels.one_task(edges, run, "id long, label long, seed long, decided boolean")
        alone = vertices.join(found, "id", "left")
        return alone.select("id", F.coalesce("label", key(F.col("id"))).alias("label"), F.coalesce("seed", "id").alias("seed"), F.coalesce("decided", F.lit(True)).alias("decided"))
    best, better = (F.min, lambda x, y: x < y) if mode == "min" else (F.max, lambda x, y: x > y)
    edges = durable(edges.distinct())
    labels = durable(vertices.select("id", key(F.col("id")).alias("label")))
    changed = labels
    while changed.head(1):
        sent = edges.join(changed.select(F.col("id").alias("src"), F.col("label").alias("l")), "src")
        # a label that does not beat the target's own priority cannot win there
        sent = sent.filter(better(F.col("l"), key(F.col("dst")))).groupBy("dst").agg(best("l").alias("l"))
        new = labels.join(sent, F.col("id") == F.col("dst"), "left")
        wins = F.coalesce(better(F.col("l"), F.col("label")), F.lit(False))
        new = durable(new.select("id", F.when(wins, F.col("l")).otherwise(F.col("label")).alias("label"), wins.alias("new")))
        labels, changed = new.select("id", "label"), new.filter("new").select("id", "label")
    seeds = labels.filter(F.col("label") == key(F.col("id"))).select(F.col("label").alias("s_label"), F.col("id").alias("seed"))
    same = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst")
    decided = durable(seeds.select(F.col("seed").alias("id")))
    front = decided
    same = durable(same)
    while front.head(1):
        front = same.join(front, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct().join(decided, "id", "left_anti")
        front = durable(front)
        decided = durable(decided.unionByName(front))
    return labels.join(seeds, F.col("label") == F.col("s_label")).join(decided.withColumn("d", F.lit(True)), "id", "left").select("id", "label", "seed", F.coalesce("d", F.lit(False)).alias("decided"))
