"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from galley.llm import license_scan, minhash_dedup, multiset_hash, ngram_join, packing, periodic_runs, prefix_forest, prefix_trie, rule_ensemble, secret_scan, shared_prefix, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_query,
    "op2_packing": packing.op2_query,
    "op3_nearest": prefix_forest.op3_query,
    "op4_warc": warc.op4_query,
    "op5_sentencepiece": shared_prefix.op5_query,
    "op6_fingerprints": multiset_hash.op6_query,
    "op7_licences": license_scan.op7_query,
    "op8_quality": rule_ensemble.op8_query,
    "op9_secrets": secret_scan.op9_query,
    "op10_ngram_join": ngram_join.op10_query,
    "op11_prefix_trie": prefix_trie.op11_query,
    "op12_periodic_runs": periodic_runs.op12_query,
    "op13_minhash": minhash_dedup.op13_query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op4_warc": warc.OP4_SQL, "op10_ngram_join": ngram_join.OP10_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op13_minhash": minhash_dedup.OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
