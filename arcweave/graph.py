"""The directed graph: vertices 0..n-1 and a multiset of edges, both DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.durable import durable

FIXTURES = {
    "g_giant": "f = 'R' AND q >= 40",
    "g_brand": "bu = bv",
    "g_type": "tu = tv",
    "g_size8": "su % 8 = sv % 8",
    "g_dense": "true",
}

#: Edges of the fixture graphs: consecutive parts of an order; valid in Spark and in DuckDB.
FIXTURE_SQL = """
WITH nx AS (
  SELECT l_partkey AS u,
         lead(l_partkey) OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS v,
         l_returnflag AS f, l_quantity AS q
  FROM lineitem),
w AS (
  SELECT nx.u, nx.v, nx.f, nx.q, pu.p_brand AS bu, pv.p_brand AS bv, pu.p_type AS tu, pv.p_type AS tv, pu.p_size AS su, pv.p_size AS sv
  FROM nx JOIN part pu ON pu.p_partkey = nx.u JOIN part pv ON pv.p_partkey = nx.v
  WHERE nx.v IS NOT NULL)
"""


@dataclass
class Digraph:
    """``vertices(id)`` and ``edges(src, dst)``; self-loops and parallel edges are legal, extra columns are dropped."""

    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, n: int | None = None) -> Digraph:
        """``n`` gives the vertices 0..n-1; without ``vertices`` and ``n``, n is the largest end plus one."""
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if vertices is None:
            if n is None:
                top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
                n = 0 if top is None else top + 1
            vertices = edges.sparkSession.range(n)
        return cls(vertices.select(F.col("id").cast("long").alias("id")), edges)

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, fixture: str = "g_size8") -> Digraph:
        """A fixture graph: parts are vertices, consecutive lines of an order are edges."""
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        part = read("part")
        lines = read("lineitem")
        sql = FIXTURE_SQL.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part ", "JOIN {part} ")
        edges = spark.sql(f"{sql} SELECT u AS src, v AS dst FROM w WHERE {FIXTURES[fixture]}", lineitem=lines, part=part)
        return cls(part.select(F.col("p_partkey").alias("id")), edges)

    def distinct(self) -> Digraph:
        """Without self-loops and parallel edges: the same components."""
        return Digraph(self.vertices, self.edges.filter("src <> dst").distinct())

    def transpose(self) -> Digraph:
        return Digraph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def materialise(self) -> Digraph:
        """Both tables written once to the shared folder, so that every superstep reads instead of recomputing."""
        return Digraph(durable(self.vertices), durable(self.edges))

    def degrees(self) -> DataFrame:
        """id, in_deg, out_deg, with multiplicity; vertices without edges have zeros."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        per = ends.groupBy("id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
        zero = F.lit(0).cast("long")
        return self.vertices.join(per, "id", "left").select("id", F.coalesce("in_deg", zero).alias("in_deg"), F.coalesce("out_deg", zero).alias("out_deg"))

    def validate(self) -> list[str]:
        """Broken invariants, in words; an empty list for a sound graph."""
        found = []
        v = self.vertices.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        if v["n"] and (v["d"] != v["n"] or v["lo"] != 0 or v["hi"] != v["n"] - 1):
            found.append("vertex ids are not exactly 0..n-1")
        if self.edges.filter("src IS NULL OR dst IS NULL").head(1):
            found.append("an edge end is null")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).filter("id IS NOT NULL")
        if ends.join(self.vertices, "id", "left_anti").head(1):
            found.append("an edge end is not a vertex")
        return found
