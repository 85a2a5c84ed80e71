"""Structural operators: CSR views, sub-graphs, label tables and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.functions.durable import durable
from arcweave.graph import Digraph

CELL = 1 << 16


def numbered(rows: DataFrame, order: list[str], out: str = "pos", cells: int | None = None) -> DataFrame:
    """Gapless positions from 0 in the order of the integer columns ``order``, without a single-task sort.

    Rows are range-partitioned by the order; positions are counted inside cells of the first column and
    shifted by the cells' running total (one row per cell).
    """
    low, high, n = rows.agg(F.min(order[0]), F.max(order[0]), F.count("*")).first()
    if not n:
        return rows.withColumn(out, F.lit(0).cast("long"))
    cells = cells or max(1, -(-n // CELL))
    width = max(1, -(-(high - low + 1) // cells))
    cell = F.floor((F.col(order[0]) - F.lit(low)) / F.lit(width)).cast("long")
    rows = rows.withColumn("_cell", cell)
    base = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    base = base.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    placed = rows.withColumn("_i", inner).join(base, "_cell")
    return placed.withColumn(out, (F.col("_i") + F.col("_base")).cast("long")).drop("_cell", "_i", "_base")


def csr_head(g: Digraph) -> DataFrame:
    """pos 0..n, off: where each vertex's row begins; the last entry is the number of edges.

    Running sums inside cells of ids plus the cells' own running sums.
    """
    degree = g.degrees().select("id", F.col("out_deg").alias("d")).withColumn("_cell", F.floor(F.col("id") / CELL))
    base = degree.groupBy("_cell").agg(F.sum("d").alias("_n"))
    base = base.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_base"))
    inside = F.sum("d").over(Window.partitionBy("_cell").orderBy("id"))
    ends = degree.withColumn("_s", inside).join(base, "_cell").select((F.col("id") + 1).alias("pos"), (F.col("_s") + F.col("_base")).cast("long").alias("off"))
    first = g.spark.range(1).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("off"))
    return first.unionByName(ends)


def csr_edges(g: Digraph) -> DataFrame:
    """pos 0..m-1, u, v: the edges in the order of (source, target)."""
    return numbered(g.edges, ["src", "dst"]).select("pos", F.col("src").alias("u"), F.col("dst").alias("v"))


def adjacency_lists(g: Digraph) -> DataFrame:
    """id, neighbours (sorted array, with multiplicity) for vertices with edges out."""
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def sub_ids(ids: DataFrame) -> DataFrame:
    """old, new: dense new ids in ascending order of the old ones."""
    return numbered(ids.select(F.col("id").alias("old")).distinct(), ["old"], "new")


def induced_subgraph(g: Digraph, ids: DataFrame, compact: bool = False):
    """The graph on ``ids`` and the edges between them; with ``compact``, (graph with dense ids, id map)."""
    ids = ids.select("id").distinct()
    edges = g.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    if not compact:
        return Digraph(ids, edges)
    names = durable(sub_ids(ids))
    a = names.select(F.col("old").alias("src"), F.col("new").alias("u"))
    b = names.select(F.col("old").alias("dst"), F.col("new").alias("v"))
    moved = edges.join(a, "src").join(b, "dst").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return Digraph(names.select(F.col("new").alias("id")), moved), names


def replicate(g: Digraph, limit: int = 1_000_000):
    """The whole graph on the driver as an Arrow table of edges; refuses more than ``limit`` edges."""
    if g.edges.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} edges")
    return g.edges.toArrow()


def self_loops(g: Digraph) -> DataFrame:
    """id, n: vertices with edges to themselves, and how many."""
    return g.edges.filter("src = dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def duplicate_edges(g: Digraph) -> DataFrame:
    """src, dst, n for edges that occur more than once."""
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1")


def graph_summary(g: Digraph) -> DataFrame:
    """One row: n, m, m_distinct, self_loops (edges), duplicates (surplus edges)."""
    n = g.vertices.agg(F.count("*").alias("n"))
    per = g.edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    e = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("m"), F.count("*").alias("m_distinct"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("k"))), F.lit(0)).alias("self_loops"))
    return n.crossJoin(e).withColumn("duplicates", F.col("m") - F.col("m_distinct"))  # one row by one row


def degree_histogram(g: Digraph) -> DataFrame:
    """in_deg, out_deg, n."""
    return g.degrees().groupBy("in_deg", "out_deg").agg(F.count("*").alias("n"))


def max_degree_stats(g: Digraph) -> DataFrame:
    """One row: max_in, max_out, arg_in (least vertex with the greatest in-degree)."""
    top = F.max(F.struct("in_deg", (-F.col("id")).alias("x")))
    return g.degrees().agg(F.max("in_deg").alias("max_in"), F.max("out_deg").alias("max_out"), (-top["x"]).alias("arg_in"))


def normalise(labels: DataFrame) -> DataFrame:
    """id, scc with every component named by its least member."""
    least = labels.groupBy("scc").agg(F.min("id").alias("least"))
    return labels.join(least, "scc").select("id", F.col("least").alias("scc"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """scc, size."""
    return labels.groupBy("scc").agg(F.count("*").alias("size"))


def component_count(labels: DataFrame) -> DataFrame:
    """One row: n_scc."""
    return labels.agg(F.countDistinct("scc").alias("n_scc"))


def size_histogram(labels: DataFrame) -> DataFrame:
    """size, n_scc."""
    return component_sizes(labels).groupBy("size").agg(F.count("*").alias("n_scc"))


def scc_summary(labels: DataFrame) -> DataFrame:
    """One row: n_scc, largest, trivial, unassigned."""
    sizes = component_sizes(labels.filter("scc IS NOT NULL"))
    stats = sizes.agg(F.count("*").alias("n_scc"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.sum((F.col("size") == 1).cast("long")), F.lit(0)).alias("trivial"))
    return stats.crossJoin(labels.agg(F.count(F.when(F.col("scc").isNull(), 1)).alias("unassigned")))  # one row by one row


def largest_members(labels: DataFrame) -> DataFrame:
    """id, scc of the largest component (least name among equals)."""
    top = component_sizes(labels).orderBy(F.desc("size"), "scc").limit(1).select("scc")
    return labels.join(F.broadcast(top), "scc").select("id", "scc")  # one row


def condensation(g: Digraph, labels: DataFrame) -> DataFrame:
    """src, dst, n: edges between components and how many edges of the graph they stand for (an extension)."""
    a = labels.select(F.col("id").alias("src"), F.col("scc").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("scc").alias("b"))
    pairs = g.edges.join(a, "src").join(b, "dst").filter("a <> b")
    return pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"))


def compare_labels(found: DataFrame, expected: DataFrame, context: int = 25) -> DataFrame:
    """Rows around the first difference of two normalised label tables: id, found, expected; empty if equal."""
    both = found.select("id", F.col("scc").alias("found")).join(expected.select("id", F.col("scc").alias("expected")), "id", "full")
    both = durable(both)
    first = both.filter(~F.col("found").eqNullSafe(F.col("expected"))).agg(F.min("id")).first()[0]
    if first is None:
        return both.limit(0)
    return both.filter(F.col("id").between(first - context, first + context))
