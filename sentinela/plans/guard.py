"""The facade: inspect a text column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.operators import ethics, evidence, mask, provenance, scan
from sentinela.operators.mask import BANNER
from sentinela.operators.patterns import Pattern


@dataclass(frozen=True)
class Config:
    """Options of an inspection; the last three are accepted and have no effect."""

    blocked_entities: Sequence[str] = ()
    known_acronyms: Sequence[str] = ()
    custom_patterns: Sequence[Pattern] = ()
    mask_mode: str = "full"
    critical_action: str = "redact"
    strict_partial: bool = False
    disclosure: bool = True
    ner: bool = False
    summary_label: str = "Ethics"
    block_threshold: str | None = None
    audit_trail: bool | None = None
    replacements: dict[str, str] | None = None


def inspect(df: DataFrame, text_col: str = "text", config: Config | None = None, inspected_at: Column | None = None, claims: Column | None = None, response_id: Column | None = None, **source: Column) -> DataFrame:
    """Adds findings, violations and the public result as separate columns, so that unused
    layers are pruned: findings, violations, score, passed, sensitivity, actions, output,
    blocked, safe, disclosure, summary, receipt and, with claims, evidence_chain and
    evidence_block. One narrow stage, batch or stream."""
    c = config or Config()
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.lit("1970-01-01T00:00:00.000Z") if inspected_at is None else inspected_at
    known = (*ethics.KNOWN_ACRONYMS, *c.known_acronyms)
    out = df.withColumns({
        "findings": scan.scan(text, extra=c.custom_patterns, ner=c.ner),
        "violations": ethics.violations(text, c.blocked_entities, known),
    })
    found, bad = F.col("findings"), F.col("violations")
    out = out.withColumns({"score": ethics.score(bad), "passed": ethics.passed(bad), "sensitivity": mask.sensitivity(found)})
    out = out.withColumns({
        "actions": mask.actions(found, F.col("sensitivity"), c.critical_action),
        "output": mask.masked(text, found, c.mask_mode, c.critical_action, c.strict_partial),
    })
    out = out.withColumn("blocked", F.startswith("output", F.lit(BANNER.split(" —")[0])))
    if c.blocked_entities:
        out = out.withColumn("output", F.when(F.col("blocked"), F.col("output")).otherwise(ethics.filter_chunk(F.col("output"), c.blocked_entities)))
    errors = F.filter(bad, lambda v: v["level"].isin("error", "critical"))
    issues = F.concat_ws(
        " | ",
        F.when(F.size(errors) > 0, F.concat(F.lit(f"{c.summary_label}: "), F.size(errors).cast("string"), F.lit(" violation(s) ("), F.array_join(F.transform(errors, lambda v: v["category"]), ", "), F.lit(")"))),
        F.when(F.size(found) > 0, F.concat(F.lit("PII: "), F.size(found).cast("string"), F.lit(" finding(s) ("), F.col("sensitivity"), F.lit(")"))),
    )
    out = out.withColumns({
        "safe": (F.size(found) == 0) & F.col("passed"),
        "disclosure": mask.disclosure(found) if c.disclosure else F.lit(""),
        "summary": F.when(issues == "", "Output is clean — no violations found.").otherwise(F.concat(F.lit("Issues found: "), issues)),
    })
    sealed = None
    if claims is not None:
        rid = F.lit("resp-0") if response_id is None else response_id
        out = out.withColumn("evidence_chain", evidence.chain(rid, at, claims)).withColumn("evidence_block", evidence.block(F.col("evidence_chain")))
        sealed = F.col("evidence_chain.auditHash")
    return out.withColumn("receipt", provenance.receipt(text, F.col("output"), at, sealed, **source))
