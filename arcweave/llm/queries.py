"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from arcweave.llm import fingerprints, knn, mixing, neardup, packing, pii, secrets, sharding, substrings, toxicity
from arcweave.llm.common import table
from arcweave.llm.sql import ORACLES  # noqa: F401  (read by the entry module)


def _documents(digest):
    return lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": _documents(neardup.digest),
    "op2_weak_supervision_pii": _documents(pii.digest),
    "op3_bounded_ring": _documents(sharding.digest),
    "op4_secret_scan": _documents(secrets.digest),
    "op5_weighted_fingerprints": _documents(fingerprints.digest),
    "op6_source_mix": _documents(mixing.digest),
    "op7_compression_toxicity": lambda spark, sf_dir: toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_suffix_dedup": _documents(substrings.digest),
    "op9_kd_top_k": lambda spark, sf_dir: knn.digest(table(spark, sf_dir, "embeddings")),
    "op10_tiered_packing": _documents(packing.digest),
}
