"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last keep the columns of ``docs``. A stage that leaves rows out
or repeats them first stores them with a number of their own and decides on that, so
rows that share a doc_id or have none are judged one by one. A stage deletes what the stages
before it have stored on the way, so its ``docs`` are to be the written result of the last one.

Defined results: as in the operators; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from sentinela.llm.common import documents, drop_written, few_joined, fresh, made, sweep, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their stored number, and its name."""
    row = fresh(docs, "_row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _keep(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in ``kept``, without it."""
    return few_joined(rows, written(kept.select(row), "kept"), row, how="left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _rows(docs)
    return _keep(rows, row, quality_rules.verdict(quality_rules.stored_ledger(rows, id_col=row)).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _rows(docs)
    return _keep(rows, row, exact_dedup.dedup(rows, row_col=row).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _rows(docs)
    # Five-word shingles and a similarity of 0.8, as stages take unless told otherwise.
    found = near_dedup.near_dedup(rows, id_col=row, width=5).select(row, "component_id")
    # Of a component the smallest doc_id stays, a null one behind every other.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    kept = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first)
    return _keep(rows, row, kept.select(F.col(f"first.{row}").alias(row)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


_left: list[str] = []  # what the last stage has stored on the way


def _swept(stage: Stage) -> Stage:
    """The stage, which first deletes what the one before it has stored on the way."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _left, docs)
        before = len(made())
        out = stage(spark, docs, sf_dir)
        _left[:] = made()[before:]
        return out

    return run_stage


STAGES = [
    ("quality_rules", _swept(quality)),
    ("exact_dedup", _swept(exact)),
    ("near_dedup", _swept(near)),
    ("source_mixing", _swept(mix)),
    ("bpe", _swept(tokens)),
]

#: The last stage has no SQL form; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop_written(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
