"""Result files of runs, ``<scaling>_<application>_np<ranks>_<graph>.json`` with one metrics tree per rank, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SECONDS = 600.0
_NAME = r"([^/_]+)_([^/_]+)_np([0-9]+)_([^/]+)[.]json$"
_LABELS = ("scaling", "app", "np", "graph")


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file and rank: the labels of the file's name, rank, scc (the tree of that scope as a map of JSON texts)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"))
    labels = [F.regexp_extract("path", _NAME, i + 1).alias(c) for i, c in enumerate(_LABELS)]
    rows = files.filter(F.col("path").rlike(_NAME)).select(*labels, F.explode(F.from_json("value", "map<string,string>")).alias("rank", "tree"))
    return rows.select(*_LABELS[:2], F.col("np").cast("int").alias("np"), "graph", F.col("rank").cast("int").alias("rank"), F.from_json(F.get_json_object("tree", "$.scc"), "map<string,string>").alias("scc"))


def scan_results(spark: SparkSession, folder: str, most_seconds: float = MOST_SECONDS) -> DataFrame:
    """scaling, app, np, graph, seconds (of the slowest rank); runs of more than ``most_seconds`` are left out."""
    seconds = F.max(F.element_at("scc", "duration").cast("long")) / 1e9
    return _ranks(spark, folder).groupBy(*_LABELS).agg(seconds.alias("seconds")).filter(F.col("seconds") <= most_seconds)


def scan_steps(spark: SparkSession, folder: str) -> DataFrame:
    """scaling, app, np, graph, stage, times, seconds (of the slowest rank), decided (over all ranks), per_second."""
    entry = _ranks(spark, folder).select(*_LABELS, "rank", F.explode("scc").alias("stage", "json")).filter("json LIKE '{%' OR json LIKE '[%'")
    listed = F.when(F.col("json").startswith("["), F.col("json")).otherwise(F.concat(F.lit("["), "json", F.lit("]")))
    runs = entry.select(*_LABELS, "rank", "stage", F.explode(F.from_json(listed, "array<struct<duration: bigint, decided_count: bigint>>")).alias("r"))
    by_rank = runs.groupBy(*_LABELS, "stage", "rank").agg(F.count("*").alias("times"), (F.sum("r.duration") / 1e9).alias("seconds"), F.sum("r.decided_count").alias("decided"))
    rows = by_rank.groupBy(*_LABELS, "stage").agg(F.max("times").alias("times"), F.max("seconds").alias("seconds"), F.sum("decided").alias("decided"))
    return rows.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("decided") / F.col("seconds")))
