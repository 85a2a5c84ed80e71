"""Pivot selection: one vertex that likely lies in the largest component; ties go to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.graph import Digraph
from arcweave.operators.trim import live_degrees


def ranked(g: Digraph, undecided: DataFrame | None = None, rule: str = "product", live: bool = False) -> DataFrame:
    """The top row: id, score. ``live`` counts only edges among the undecided vertices."""
    degrees = live_degrees(g, undecided) if live and undecided is not None else g.degrees()
    if undecided is not None and not live:
        degrees = degrees.join(undecided.select("id"), "id", "left_semi")
    score = F.col("in_deg") * F.col("out_deg") if rule == "product" else F.col("in_deg")
    return degrees.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(1)


def select_pivot(g: Digraph, undecided: DataFrame | None = None, rule: str = "product", live: bool = False) -> int | None:
    row = ranked(g, undecided, rule, live).first()
    return None if row is None else row["id"]
