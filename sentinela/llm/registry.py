"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from sentinela.llm import bpe, ctw, exact_dedup, licences, mixing, near_dedup, pii, quality_rules, substring_dedup, warc

QUERIES = {
    "op3_ctw": ctw.op3_ctw,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op1_bpe": bpe.op1_bpe,
    "op2_mixing": mixing.op2_mixing,
    "op8_licences": licences.op8_licences,
    "op7_pii": pii.op7_pii,
    "op10_warc": warc.op10_warc,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "quality_ablation": quality_rules.quality_ablation,
}

ORACLES = {
    "op5_near_dedup": near_dedup.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op8_licences": licences.ORACLE,
    "op10_warc": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "quality_ablation": quality_rules.ABLATION_ORACLE,
}
