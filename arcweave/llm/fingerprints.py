"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with counts w. For sample k and word x, a hash gives r, c ~ Gamma(2, 1) and
b ~ U(0, 1); t = floor(ln w / r + b), ln a = ln c - r (t - b + 1), and the sample is the word and step of least a.
a is a function of (k, x, t) alone, so two texts share sample k exactly if their least a agree: with
probability equal to the generalised Jaccard similarity sum(min w) / sum(max w). A fingerprint is the K least
values, each hashed to 32 bits; likeness is the share of equal samples.

Gamma(2, 1) is -ln(u v) for two uniform numbers; the four of a draw are 12-bit slices of one 64-bit hash,
the shift b its last 16 bits. Everything is built-in functions in generated code.

A text is moved once: documents are cut into id ranges of about equal counts, each range also carries the first
document of the next one, and all later steps (next document, edited text, word counts, samples, comparison)
are grouped by range or by (range, document) and so need no second exchange of words.

Edge cases: a null text counts as empty; an empty text has one special term, so empty texts are
alike and unlike all others; equal texts have equal fingerprints; rows that share an id are ordered by
text, null ids come first; with one document it is its own successor; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.llm.common import partitions, text_or_empty

SAMPLES = 32
_STEPS = 4096
_SPACE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Words of a text; the empty string stands for a text without any."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), _SPACE)


def _ln_a(k: int, word: Column, log_w: Column) -> Column:
    h = F.xxhash64(word, F.lit(k))

    def uniform(shift: int) -> Column:
        return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_STEPS - 1)) + 0.5) / float(_STEPS)

    r = -F.log(uniform(0) * uniform(12))
    c = -F.log(uniform(24) * uniform(36))
    b = (F.shiftrightunsigned(h, 48) + 0.5) / 65536.0
    return F.log(c) - r * (F.floor(log_w / r + b) - b + 1)


def signatures(bags: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, word, w), one row per distinct word -> (keys, sig array<int>)."""
    rows = bags.select(*keys, F.xxhash64("word").alias("h"), F.log(F.col("w").cast("double")).alias("log_w"))
    least = rows.groupBy(*keys).agg(*[F.min(_ln_a(k, F.col("h"), F.col("log_w"))).alias(f"a{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[F.hash(f"a{k}") for k in range(samples)]).alias("sig"))


def likeness(x: Column, y: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two signatures."""
    same = F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return same / F.lit(float(samples))


def hexed(sig: Column) -> Column:
    """A signature as a hex string, eight digits per sample."""
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fingerprint(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id: id, sig. Rows that share an id are one bag of words."""
    words = docs.select(F.col(id_col), F.explode(terms(text_or_empty(text_col))).alias("word"))
    return signatures(words.groupBy(id_col, "word").agg(F.count("*").alias("w")), [id_col], samples)


def _rank_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``value`` (null: none), in two steps of about sqrt(n) comparisons."""
    step = math.isqrt(len(cuts)) + 1
    below = lambda numbers: F.size(F.filter(numbers, lambda c: c < value))
    coarse = below(F.lit(cuts[step - 1 :: step]))
    fine = below(F.slice(F.lit(cuts), coarse * step + 1, F.lit(step)))
    return F.when(value.isNull(), F.lit(0)).otherwise(coarse * step + fine).cast("int")


def ranges(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``part``, an id range of about equal count, and ``guest``.

    Each range that has rows also gets the first row of the next such range (the last range that of the first)
    as its guest. Range ends are approximate quantiles of the ids; where they fall changes no result.
    """
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    rows = docs.withColumn("part", _rank_of(F.col("doc_id"), cuts) if cuts else F.lit(0))
    first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    order = Window.orderBy("part")
    hosts = first.select(F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("part"), F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"))
    return rows.withColumn("guest", F.lit(0)).unionByName(hosts.withColumn("guest", F.lit(1)))


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by id.

    Returns doc_id, n_chars, edited_sha256, sig, edited_sig, next_sig.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    rows = ranges(docs, 4 * partitions(docs.sparkSession)).select("part", "guest", "doc_id", "text", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next_text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("part", "guest", "pos", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = rows.select("part", "pos", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v")).filter("v.t IS NOT NULL")
    words = both.select("part", "pos", F.col("v.kind").alias("kind"), F.explode(terms(F.col("v.t"))).alias("word"))
    sigs = signatures(words.groupBy("part", "pos", "kind", "word").agg(F.count("*").alias("w")), ["part", "pos", "kind"], samples)
    pair = sigs.groupBy("part", "pos").agg(*[F.first(F.when(F.col("kind") == k, F.col("sig")), ignorenulls=True).alias(name) for k, name in ((0, "sig"), (1, "edited_sig"))])
    pair = pair.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("part").orderBy("pos")))
    about = rows.filter("guest = 0").select("part", "pos", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return about.join(pair, ["part", "pos"]).select("doc_id", "n_chars", "edited_sha256", "sig", "edited_sig", "next_sig")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    sig = F.col("sig")
    return compare(docs).select("doc_id", "n_chars", "edited_sha256", hexed(sig).alias("fingerprint"), hexed(F.col("edited_sig")).alias("edited_fingerprint"), likeness(sig, F.col("edited_sig")).alias("near_edited"), likeness(sig, F.col("next_sig")).alias("near_next"))
