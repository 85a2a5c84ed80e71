"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / quality, with u a hash of the document, so reruns
agree. A source's target in words is met by complete epochs first; the rest is a weighted sample without
replacement: the documents with the smallest keys whose running size fits the remaining budget, and the
document that crosses it where this brings the sum nearer.

No source is ever sorted as a whole. Keys are cut into ``BINS`` ranges per source; summed sizes per
(source, bin) (aggregated before the shuffle) give running sums, whole bins below or above the budget are
decided at once, and only the one bin that the budget crosses is split again, and at last sorted. A source
with a third of all rows therefore costs a task only its one crossing bin of the second level.

Edge cases: null text has size 0; null source is a source of its own, last in order; documents of size 0 are
taken as often as epochs run, 0 words; identical rows share a key and are ordered by size; an empty table
gives an empty result; extra columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import durable, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BINS = 4096
SALT = 64
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(_WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """Document quality in [0.05, 1]: falls with the share of markup-like characters."""
    t = text_or_empty(text)
    n = F.length(t)
    junk = n - F.length(F.translate(t, "*&$%#|<>{}=", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * junk / n)).otherwise(F.lit(1.0))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the id: 52 bits of its MD5."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also target.

    Resharing the excess by weight until no source is above ``most`` times its size ends at
    min(most * size, level * weight) for one level; sorting by size / weight finds it with two running sums. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_left": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(Window.partitionBy())})
    # the level that would hold if exactly the sources before this one were at their caps
    rows = rows.withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("w_left"))
    rows = rows.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("cap") / F.col("w"))).over(Window.partitionBy())
    return rows.withColumn("target", F.when(F.col("fits") | level.isNull(), F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))).otherwise(F.least(F.col("cap"), level * F.col("w")))).select("source", "source_size", "target")


def _crossing(rows: DataFrame, budget: DataFrame, bin_col: str) -> DataFrame:
    """Per source: the bin that the budget crosses and the words that lie in bins before it."""
    sums = rows.groupBy("source", bin_col).agg(F.sum("size").alias("s"))
    w = Window.partitionBy("source").orderBy(bin_col)
    run = sums.withColumn("upto", F.sum("s").over(w))
    run = run.join(budget, run["source"].eqNullSafe(budget["b_source"]))
    return run.filter((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("s") < F.col("budget"))).groupBy("source").agg(F.min(bin_col).alias("cross"), F.min(F.col("upto") - F.col("s")).alias("below"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, bins: int = BINS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (complete ones), picked (0 or 1), key, taken."""
    keyed = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / quality_of(F.col("text"))).alias("key"))
    # 1 - exp(-key) spreads the keys of unit quality evenly over the bins
    spread = F.lit(1.0) - F.exp(-F.col("key"))
    keyed = durable(keyed.withColumns({"bin": F.floor(spread * bins).cast("int"), "fine": F.floor(spread * bins * 1024).cast("long")}))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = durable(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "b_source"))
    at = _crossing(keyed, goal.filter("budget > 0").select("b_source", "budget"), "bin").select(F.col("source").alias("c_source"), "cross", "below")
    goal = durable(goal.join(at, goal["b_source"].eqNullSafe(at["c_source"]), "left").drop("c_source"))
    # a source's row meets its documents in SALT places, so no task holds a source
    salted = goal.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALT)).cast("int"))
    rows = rows.join(salted, rows["source"].eqNullSafe(salted["b_source"]) & (rows["salt"] == salted["b_salt"])).drop("b_source", "salt", "b_salt")
    crossing = F.coalesce(F.col("bin") == F.col("cross"), F.lit(False))
    clear = rows.filter(~crossing).withColumn("picked", F.when((F.col("budget") > 0) & (F.col("cross").isNull() | (F.col("bin") < F.col("cross"))), 1).otherwise(0))
    # second level: only the crossing bin of each source
    inside = rows.filter(crossing)
    w = Window.partitionBy("source").orderBy("fine")
    steps = inside.groupBy("source", "fine").agg(F.sum("size").alias("s"), F.first("budget").alias("budget"), F.first("below").alias("below")).withColumn("upto", F.col("below") + F.sum("s").over(w))
    fine = steps.filter((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("s") < F.col("budget"))).groupBy("source").agg(F.min("fine").alias("f_cross"), F.min(F.col("upto") - F.col("s")).alias("f_below")).withColumnRenamed("source", "f_source")
    inside = inside.join(fine, inside["source"].eqNullSafe(fine["f_source"]), "left").drop("f_source")
    last = F.coalesce(F.col("fine") == F.col("f_cross"), F.lit(False))
    sure = inside.filter(~last).withColumn("picked", F.coalesce(F.col("fine") < F.col("f_cross"), F.lit(True)).cast("int"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = inside.filter(last).withColumn("upto", F.col("f_below") + F.sum("size").over(order))
    near = (F.col("upto") <= F.col("budget")) | ((F.col("upto") - F.col("size") < F.col("budget")) & (F.col("upto") - F.col("budget") <= F.col("budget") - F.col("upto") + F.col("size")))
    tail = tail.withColumn("picked", near.cast("int")).drop("upto")
    out = clear.unionByName(sure, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True)
    return out.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("picked"))).select("doc_id", "source", "size", "source_size", "target", "epochs", "picked", "key", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan takes it (not at all, once or more).

    Rows that share id and source share the decision, so equal rows stay together.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", "source", own.alias("row"))
    p = plan(docs, **options)
    times = p.groupBy("doc_id", "source").agg(F.max(F.col("epochs") + F.col("picked")).cast("int").alias("times")).withColumnsRenamed({"doc_id": "id", "source": "of"})
    rows = rows.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of"))).filter("times > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs", "picked")
