"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.durable import checkpoint_dir, durable  # noqa: F401  (shared with the operators here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def inline_table(spark: SparkSession, rows_json: str, ddl: str) -> DataFrame:
    """A small driver-made table as a JVM-side literal (no Python on executors)."""
    one = spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{ddl}>>")))
    return one


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column, step: int = 512):
    """The values of an Arrow column, turned into Python objects ``step`` at a time to bound memory."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()
