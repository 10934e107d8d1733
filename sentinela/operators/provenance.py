"""Hashes, canonical rows, audit fields and inspection receipts."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.functions.text import java_regex

#: Fixed value: the version that receipts carry.
VERSION = "0.2.2"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, java_regex(r"^\s+|\s+$"), "")


def canonical_row(columns: list[str]) -> Column:
    """Compact JSON of flat columns by name, nulls kept."""
    ordered = sorted(columns, key=lambda c: (c.lower(), c.swapcase()))
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_json(raw: Column) -> Column:
    """Canonical form of arbitrary JSON text (nested keys sorted), in Arrow batches."""

    def sort(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: sort(v[k]) for k in sorted(v, key=lambda c: (c.lower(), c.swapcase()))}
        if isinstance(v, list):
            return [sort(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e21 else v

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else json.dumps(sort(json.loads(t)), ensure_ascii=False, separators=(",", ":")))

    return canonical(raw)


def row_hash(columns: list[str]) -> Column:
    return sha256(canonical_row(columns))


def fingerprint(url: Column, method: Column, collected_at: Column) -> Column:
    return sha256(F.concat_ws("|", trimmed(url), trimmed(method), trimmed(collected_at)))


def _method(method: Column) -> Column:
    return F.when(trimmed(method) == "", "unknown").otherwise(trimmed(method))


def audit_fields(row: Column, url: Column, method: Column, at: Column) -> Column:
    """``row``: canonical JSON of the source row. A blank method reads unknown, but the
    fingerprint takes it as it is."""
    return F.struct(
        sha256(row).alias("raw_line_hash"), trimmed(url).alias("source_url"), _method(method).alias("source_method"), at.alias("verified_at"), F.lit("verified").alias("audit_status"), fingerprint(url, method, at).alias("source_fingerprint")
    )


def receipt(text: Column, output: Column, inspected_at: Column, evidence_hash: Column | None = None, url: Column | None = None, method: Column | None = None, collected_at: Column | None = None, row: Column | None = None, query: Column | None = None, record_id: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    url, method, row, query, record_id, evidence_hash = (none if c is None else c for c in (url, method, row, query, record_id, evidence_hash))
    at = inspected_at if collected_at is None else F.coalesce(collected_at, inspected_at)
    known = F.coalesce((url != "") & (method != ""), F.lit(False))
    level = F.when(known & row.isNotNull(), "source_row_bound").when(known, "source_context").otherwise("inspection_only")
    print_ = F.when(known, fingerprint(url, method, at))
    input_hash, output_hash = sha256(text), sha256(output)
    sealed = F.to_json(
        F.struct(
            input_hash.alias("inputHash"), output_hash.alias("outputHash"), inspected_at.alias("inspectedAt"), evidence_hash.alias("evidenceHash"),
            print_.alias("sourceFingerprint"), F.lit(VERSION).alias("guardVersion"), level.alias("provenanceLevel"),
        ),
        {"ignoreNullFields": "false"},
    )
    source = F.when(
        known,
        F.struct(
            F.when(row.isNotNull(), sha256(row)).alias("raw_line_hash"), trimmed(url).alias("source_url"), _method(method).alias("source_method"), at.alias("verified_at"),
            F.when(row.isNotNull(), F.lit("verified")).alias("audit_status"), print_.alias("source_fingerprint"), F.when(query != "", sha256(query)).alias("queryHash"), F.when(record_id != "", record_id).alias("recordId"), level.alias("provenanceLevel"),
        ),
    )
    return F.struct(
        inspected_at.alias("inspectedAt"), input_hash.alias("inputHash"), output_hash.alias("outputHash"), sha256(sealed).alias("inspectionHash"), F.lit(VERSION).alias("guardVersion"),
        evidence_hash.alias("evidenceHash"), level.alias("provenanceLevel"), source.alias("source"),
    )
