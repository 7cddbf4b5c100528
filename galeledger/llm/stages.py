"""The stages of the corpus pipeline: each applies one operator's decisions to documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .decontaminate import decontaminated
from .pieces import encoded
from .quality import quality
from .secrets import masked, secrets
from .simhash import near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, with the lines that pass as their text."""
    out = quality(docs).where("kept")
    cleaned = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.withColumns({k: v for k, v in cleaned.items() if k in docs.columns}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret in the text replaced by a mark."""
    out = secrets(docs)
    hidden = out.withColumn("text", masked(F.col("text"), F.col("secret_spans")))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast("long"))
    return hidden.select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, ids) of every document."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
