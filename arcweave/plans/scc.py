"""Strongly connected components: interchangeable plans made of the same stages.

A plan is a list of stages over the undecided vertices and the edges between them. After each stage the decided
vertices and their edges leave (two semi-joins), so later stages see a shrinking graph. As soon as the live
edges are at most ``residual_edges``, whatever is left goes to one sequential kernel; 0 keeps a plan pure.
All plans give the same normalised labels.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.durable import durable
from arcweave.graph import Digraph
from arcweave.operators import color, components, kernels, pivot, reach, structure, tarjan, trim
from arcweave.plans.metrics import Metrics

RESIDUAL_EDGES = 500_000

#: Stages in order; a tuple ("loop", ...) repeats until nothing is undecided, ("until_small", ...) until the rest fits the kernel.
PLANS: dict[str, tuple] = {
    "default": ("trim_first", "forward_backward", "trim_normal", ("loop", "color")),
    "color_rounds": ("trim_first", "forward_backward", ("loop", "color")),
    "peel_first": ("trim_exhaustive", "forward_backward_live", ("loop", "color")),
    "trim_residual": ("trim_first", "forward_backward", "trim_normal", "trim_normal", "residual"),
    "peel_rounds": ("trim_exhaustive", "forward_backward_live", "trim_exhaustive", ("loop", "color", "trim_exhaustive")),
    "peel_light_residual": ("trim_exhaustive", "forward_backward_live", ("until_small", "color"), "trim_exhaustive", "residual"),
    "peel_residual": ("trim_exhaustive", "forward_backward_live", "trim_exhaustive", ("until_small", "color", "trim_exhaustive"), "residual"),
    "eager_rounds": ("trim_first", "forward_backward", "trim_normal", ("loop", "color_unrotated")),
    "tarjan": ("residual",),
    "weak_split": ("trim_first", "forward_backward", "trim_either", "trim_either", "weak_residual", ("loop", "color")),
    "max_color": ("forward_backward", ("loop", "color_max")),
}


class _Run:
    def __init__(self, g: Digraph, plan: str, residual_edges: int, local_edges: int, pure: bool = False):
        self.plan, self.residual_edges, self.local_edges, self.pure = plan, residual_edges, local_edges, pure
        self.g = Digraph(durable(g.vertices), durable(g.edges))  # with multiplicity, for degrees
        self.undecided, self.live = self.g.vertices, durable(self.g.edges.filter("src <> dst").distinct())
        self.left = self.undecided.count()
        self.decided: list[DataFrame] = []
        self.stats: list[dict] = []
        self.rounds = 0
        self.metrics = Metrics()

    def graph(self) -> Digraph:
        return Digraph(self.undecided, self.live)

    def accept(self, stage: str, labels: DataFrame, began: float) -> None:
        labels = durable(labels.select("id", "scc"))
        self.decided.append(labels)
        self.undecided = durable(self.undecided.join(labels, "id", "left_anti"))
        self.live = durable(trim.live_edges(self.live, self.undecided))
        left = self.undecided.count()
        self.stats.append({"plan": self.plan, "ord": len(self.stats), "stage": stage, "rounds": self.rounds, "decided": self.left - left, "undecided_after": left, "live_edges_after": self.live.count(), "seconds": time.time() - began})
        self.left = left

    def small(self) -> bool:
        return kernels.fits(self.live, self.residual_edges)

    def most(self) -> int:
        """Edges that a plan's own sequential stage takes."""
        return self.residual_edges if self.pure else self.residual_edges or RESIDUAL_EDGES

    def stage(self, name: str) -> None:
        began = time.time()
        with self.metrics.scope(name):
            before = self.left
            self.accept(name, self.labels(name), began)
            self.metrics.value("decided_count", before - self.left)

    def labels(self, name: str) -> DataFrame:
        own = F.col("id").alias("scc")
        limit = self.local_edges
        if name == "trim_first":
            return trim.trim_first(self.g).join(self.undecided, "id", "left_semi").select("id", own)
        if name in ("trim_normal", "trim_either"):
            return trim.trim_normal(self.graph(), mode="both" if name == "trim_normal" else "either").select("id", own)
        if name == "trim_exhaustive":
            return trim.trim_exhaustive(self.graph(), local_edges=limit).select("id", own)
        if name.startswith("forward_backward"):
            live = name.endswith("live")
            chosen = pivot.select_pivot(self.graph() if live else self.g, self.undecided, live=live)
            self.metrics.value("pivot", chosen)
            return reach.forward_backward(self.graph(), chosen, local_edges=limit)
        if name.startswith("color"):
            self.rounds += 1
            rotation = 0 if name == "color_unrotated" else self.rounds
            found = color.color_round(self.graph(), rotation=rotation if name == "color" else 0, mode="max" if name == "color_max" else "min", local_edges=limit)
            return found.filter("decided").select("id", F.col("seed").alias("scc"))
        if name == "weak_residual":
            weak = durable(components.wcc(self.graph()))
            # a weak component with more edges than a task may hold is left to the rounds that follow
            sizes = tarjan.within(weak, self.live, "wcc").groupBy(F.col("_g").alias("wcc")).agg(F.count("*").alias("edges"))
            large = sizes.filter(F.col("edges") > tarjan.MOST_EDGES).select("wcc")
            return tarjan.tarjan_by_group(durable(weak.join(large, "wcc", "left_anti")), self.live, "wcc")
        return tarjan.tarjan(self.graph())

    def run(self, stages: tuple) -> None:
        for s in stages:
            if self.left == 0:
                return
            if isinstance(s, tuple):
                self.loop(s)
            elif s == "residual" and not kernels.fits(self.live, self.most()):
                self.loop(("until_small", "color"))  # too much for one task yet
                if self.left:
                    self.stage("residual")
            elif self.residual_edges and not self.pure and s != "trim_first" and self.small():
                self.stage("residual")
                return
            else:
                self.stage(s)

    def loop(self, s: tuple) -> None:
        while self.left:
            if ((self.residual_edges and not self.pure) or s[0] == "until_small") and kernels.fits(self.live, self.most()):
                if s[0] == "loop":
                    self.stage("residual")
                return
            for inner in s[1:]:
                if self.left:
                    self.stage(inner)


def scc(g: Digraph, plan: str = "default", normalise: bool = True, residual_edges: int = RESIDUAL_EDGES, local_edges: int = trim.LOCAL_EDGES, stats: list | None = None, metrics: Metrics | None = None, pure: bool = False) -> DataFrame:
    """id, scc for every vertex. ``stats`` gets one row per stage; ``normalise=False`` keeps the plan's own names.

    ``residual_edges``: from when on the rest goes to the sequential kernel (0: never, for a pure plan);
    ``local_edges``: up to when a single operator runs as an array kernel (0: never);
    ``pure``: the sequential kernel runs only as the stage that a plan itself names, once ``residual_edges`` or fewer are live.
    """
    if plan not in PLANS:
        raise ValueError(f"unknown plan {plan}; known: {', '.join(PLANS)}")
    run = _Run(g, plan, residual_edges, local_edges, pure)
    with run.metrics.scope("scc"):
        run.run(PLANS[plan])
    if stats is not None:
        stats += run.stats
    if metrics is not None:
        metrics.root |= run.metrics.root
    out = g.vertices.limit(0).select("id", F.lit(None).cast("long").alias("scc"))
    for d in run.decided:
        out = out.unionByName(d)
    return structure.normalise(out) if normalise else out


def stage_stats(g: Digraph, plan: str = "default", **options) -> DataFrame:
    """One row per stage: plan, ord, stage, rounds, decided, undecided_after, live_edges_after, seconds."""
    rows: list[dict] = []
    scc(g, plan, stats=rows, **options)
    return g.spark.createDataFrame([tuple(r.values()) for r in rows], "plan string, ord int, stage string, rounds int, decided long, undecided_after long, live_edges_after long, seconds double")
