"""Consistent hashing with virtual nodes and bounded loads.

Each shard owns ``virtual`` points of a 64-bit ring; a key belongs to the first point at or after its own
hash. A shard that is full passes its later keys on, clockwise, to the next point whose shard has room.
All keys of one arc (the gap between two points) are alike for this rule, so the walk is planned on
the counts per arc: at most ``shards * virtual`` numbers, a bound that does not depend on the data. The plan is a
list of rank intervals (arc, first rank, length) -> (shard, first slot), at most arcs + shards of them.
Documents then look up their interval by their rank within the arc. Everything on the documents is built-in
functions; ranks are taken in small cells of the ring (``cells`` to an arc), so no window holds a whole arc.

Capacities add up to the number of documents exactly (factor 1) or to ``load`` times that. With factor 1 every
shard is exactly full at the end, and counts are at most one apart: the law ``rows``.

Edge cases: null text has no bytes; a null id hashes like any other value (all null ids meet in one
cell unless their texts differ); repeated rows are separate keys; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import inline_table, text_or_empty

SHARDS = 40
VIRTUAL = 64
CELLS = 16
_BUCKETS = 4096  # top 12 bits of the ring, to find an arc with one small lookup


def ring(spark, shards: int, virtual: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; positions come from the engine's own hash."""
    points = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("at"))
    return sorted((r["at"], r["shard"]) for r in points.collect())


def walk(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Plan the overflow: intervals (arc, first rank, length, shard, first slot).

    Round k offers what is left of arc a to the owner of point a + k; a shard takes offers in ring order
    until it is full. Ends when nothing is left, which total capacity guarantees.
    """
    left, done, filled, out = list(counts), [0] * len(counts), [0] * len(capacity), []
    open_arcs = [a for a, c in enumerate(left) if c]
    for k in range(len(owners)):
        if not open_arcs:
            break
        rest = []
        for a in open_arcs:
            s = owners[(a + k) % len(owners)]
            n = min(left[a], capacity[s] - filled[s])
            if n > 0:
                out.append((a, done[a], n, s, filled[s]))
                done[a] += n
                left[a] -= n
                filled[s] += n
            if left[a]:
                rest.append(a)
        open_arcs = rest
    if open_arcs:
        raise ValueError("total capacity is below the number of keys")
    return out


def capacities(n: int, shards: int, load: float = 1.0) -> list[int]:
    """``load`` 1: n split exactly, the first n % shards one larger; else ceil(load * n / shards) each."""
    if load <= 1.0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [math.ceil(load * n / shards)] * shards


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, load: float = 1.0, cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, hops (points passed on the ring)."""
    spark = docs.sparkSession
    points = ring(spark, shards, virtual)
    ats, owners = [p for p, _ in points], [s for _, s in points]
    step = 2**64 // _BUCKETS
    lookup = []
    for b in range(_BUCKETS):
        lo = -(2**63) + b * step
        i, j = bisect.bisect_left(ats, lo), bisect.bisect_left(ats, lo + step)
        lookup.append({"bucket": b, "first": i, "bounds": [str(x) for x in ats[i:j]]})
    arcs = inline_table(spark, json.dumps(lookup), "bucket int, first int, bounds array<string>").withColumn("bounds", F.transform("bounds", lambda x: x.cast("long")))
    text = text_or_empty("text")
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id").alias("at"))
    keys = keys.withColumn("bucket", (F.shiftright("at", 52) + _BUCKETS // 2).cast("int"))
    keys = keys.join(F.broadcast(arcs), "bucket")  # 4,096 rows
    arc = (F.col("first") + F.size(F.filter("bounds", lambda x: x < F.col("at")))) % len(points)
    keys = keys.withColumn("arc", arc.cast("int")).withColumn("cell", F.pmod(F.xxhash64("at", "text_crc32"), F.lit(cells)).cast("int")).drop("bucket", "first", "bounds")
    counted = {(r["arc"], r["cell"]): r["count"] for r in keys.groupBy("arc", "cell").count().collect()}  # arcs x cells numbers at most
    per_arc, before = [0] * len(points), [[0] * cells for _ in points]
    for (a, c), n in sorted(counted.items()):
        per_arc[a] += n
    for a in range(len(points)):
        for c in range(1, cells):
            before[a][c] = before[a][c - 1] + counted.get((a, c - 1), 0)
    by_arc: dict[int, list] = {}
    for a, first, n, s, slot in walk(per_arc, owners, capacities(sum(per_arc), shards, load)):
        by_arc.setdefault(a, []).append({"first": first, "upto": first + n, "shard": s, "slot": slot})
    plan = json.dumps([{"arc": a, "base": before[a], "steps": steps} for a, steps in by_arc.items()])
    table = inline_table(spark, plan, "arc int, base array<long>, steps array<struct<first: long, upto: long, shard: int, slot: long>>")
    rank = F.row_number().over(Window.partitionBy("arc", "cell").orderBy("at", "doc_id", "text_crc32", "size")) - 1
    placed = keys.withColumn("rank", rank).join(F.broadcast(table), "arc")  # one row per arc
    placed = placed.withColumn("rank", F.col("rank") + F.element_at("base", F.col("cell") + 1))
    step_of = F.element_at(F.filter("steps", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["upto"])), 1)
    return placed.withColumn("step", step_of).select("doc_id", "size", "text_crc32", F.col("step.shard").alias("shard"), (F.col("step.slot") + F.col("rank") - F.col("step.first")).alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns under the law ``rows``."""
    placed = assign(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
