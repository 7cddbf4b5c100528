"""Corpus pipeline: documents through quality rules, near-duplicates, decontamination, secrets and pieces."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galeledger.llm import stages
from galeledger.session import settle

# (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("secret_scan", stages.secret_scan),
    ("sentence_pieces", stages.sentence_pieces),
]

# No SQL form: fingerprints, components, the latent search and the transducer are not expressible in DuckDB SQL.
# tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
