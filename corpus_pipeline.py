"""From raw documents to packed training sequences.

Each stage reads what the one before it wrote. Bad documents go, one of each
group of near copies stays, secrets are masked, and the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from galley.llm.ngram_join import STAGE_PERCENT, STAGE_WIDTH, near_duplicates_stage
from galley.llm.packing import packing_stage
from galley.llm.rule_ensemble import quality_stage
from galley.llm.secret_scan import secrets_stage
from galley.sources.files import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", partial(near_duplicates_stage, width=STAGE_WIDTH, percent=STAGE_PERCENT)),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Fitting a classifier and tokenizing are beyond SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
