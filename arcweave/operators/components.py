"""Weakly connected components by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.durable import durable


def _follow(to: DataFrame) -> DataFrame:
    """(id, to) with every chain of ``to`` followed to its end, by doubling; ids never grow along a chain."""
    while True:
        end = to.select(F.col("id").alias("at"), F.col("to").alias("there"))
        to = durable(to.join(end, F.col("to") == F.col("at")).select("id", F.col("there").alias("to"), (F.col("to") != F.col("there")).alias("moved")))
        if not to.filter("moved").head(1):
            return to.select("id", "to")


def star_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (id, component): the least id of each component, for every id that occurs.

    In a round every vertex points to its least neighbour or itself, chains of these are followed to their ends (vertices
    alone, doubling), and the edges move to the ends. Ends are never neighbours of each other, so the graph at least halves each
    round. The maps of all rounds, ever smaller ones, are put together last. Self-loops and repeats are harmless.
    """
    own = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    both = edges.filter("src <> dst")
    both = durable(both.select("src", "dst").unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    maps = []
    while both.head(1):
        least = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("to"))
        maps.append(_follow(durable(least)))
        a, b = (maps[-1].select(F.col("id").alias(end), F.col("to").alias(f"{end}_to")) for end in ("src", "dst"))
        moved = both.join(a, "src").join(b, "dst").filter("src_to <> dst_to")
        both = durable(moved.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).distinct())
    if not maps:
        return own.select("id", F.col("id").alias("component"))
    whole = maps.pop()
    while maps:
        ends = whole.select(F.col("id").alias("at"), F.col("to").alias("there"))
        whole = durable(maps.pop().join(ends, F.col("to") == F.col("at"), "left").select("id", F.coalesce("there", "to").alias("to")))
    return own.join(whole, "id", "left").select("id", F.coalesce("to", "id").alias("component"))


def wcc(g, undecided: DataFrame | None = None) -> DataFrame:
    """Weakly connected components of the undecided vertices: id, wcc (the least member)."""
    from arcweave.operators.trim import live_edges

    vertices = (g.vertices if undecided is None else undecided).select("id")
    found = star_components(live_edges(g.edges, undecided))
    return vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("wcc"))
