"""Text edge lists: two non-negative integers a line, anything after them ignored; %, # and // start comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = r"^\s*([0-9]+)\s+([0-9]+)"


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst in any order; a line that is neither blank, comment nor pair raises an error."""
    lines = spark.read.text(path).filter("value <> '' AND NOT startswith(value, '%') AND NOT startswith(value, '#') AND NOT startswith(value, '//')")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
    checked = F.when(F.col("value").rlike(_PAIR), F.col("value")).otherwise(bad)
    return lines.select(checked.alias("value")).select(*[F.regexp_extract("value", _PAIR, i + 1).cast("long").alias(c) for i, c in enumerate(("src", "dst"))])


def write_edge_list(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of text files, one edge a line."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode(mode).text(path)


def write_labels(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Component names one a line, in the order of the vertices (files sort by range)."""
    labels.orderBy("id").select(F.col("scc").cast("string").alias("value")).write.mode(mode).text(path)


def convert_stats(edges: DataFrame) -> dict:
    """n (largest end plus one), m, and the two flags of a manifest."""
    row = edges.agg(F.max(F.greatest("src", "dst")).alias("top"), F.count("*").alias("m"), F.coalesce(F.max(F.col("src") == F.col("dst")), F.lit(False)).alias("loops")).first()
    twice = bool(edges.groupBy("src", "dst").count().filter("count > 1").head(1))
    return {"node_count": 0 if row["top"] is None else row["top"] + 1, "edge_count": row["m"], "contains_self_loops": row["loops"], "contains_duplicate_edges": twice}
