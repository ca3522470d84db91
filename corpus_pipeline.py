"""The corpus pipeline: quality rules, language ID, near-dedup, PII, packing - each stage a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwarden.llm.common import scratch, table, written
from tagwarden.llm.language_id import keep_known
from tagwarden.llm.length_buckets import pack_stage
from tagwarden.llm.pii_semicrf import redact
from tagwarden.llm.quality_rules import keep_good
from tagwarden.llm.simhash_bk import keep_one

STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_known),
    ("simhash_near_dedup", keep_one),
    ("pii", redact),
    ("packing", pack_stage),
]

ORACLE_SQL = None  # the stages are not all expressible in SQL; tests/llm holds them against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; every stage's rows are written as Parquet and read back.

    Once a stage's table is written, what the stage made on the way and the table before it are deleted.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            result = made.pop()  # the last folder named is the table's
            made += [before] if before else []
        before = result
    return docs
