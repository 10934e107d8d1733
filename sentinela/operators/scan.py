"""Scanning: patterns and name rules to disjoint findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.functions.text import bound, disjoint, group_spans, spans
from sentinela.operators import patterns as P
from sentinela.operators.checksums import VALIDATORS

FINDING = "array<struct<category:string,label:string,start:int,end:int,matched:string,suggestion:string>>"
MATCH = "array<struct<pattern_id:string,label:string,start:int,end:int,matched:string,confidence:string,mask_format:string>>"
_FINDING_FIELDS = ["category", "label", "matched", "suggestion"]
_MATCH_FIELDS = ["pattern_id", "label", "matched", "confidence", "mask_format"]


def _tagged(found: Column, prio: int, **tags: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(prio).alias("prio"), m["matched"].alias("matched"), *[F.lit(v).alias(k) for k, v in tags.items()]),
    )


def _all(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def detect_pii(text: Column, patterns: Sequence[P.Pattern] = P.DEFAULT) -> Column:
    """Matches of the patterns, de-overlapped; no names and no birth dates by default."""

    def found(text: Column, digits: Column) -> Column:
        tags = lambda p: {"pattern_id": p.id, "label": p.label, "confidence": p.confidence, "mask_format": p.mask}
        return disjoint(_all([_tagged(spans(text, p.source, p.flags, digits), k, **tags(p)) for k, p in enumerate(patterns)]), _MATCH_FIELDS)

    return F.coalesce(bound(text, found), F.array().cast(MATCH))


def detect_secrets(text: Column) -> Column:
    return detect_pii(text, P.SECRETS)


def ner_findings(text: Column, prio: int = 0) -> Column:
    """Name rules A, B, D-J, then C; not de-overlapped."""
    parts = []
    for rule_id, label, before, after, flags in P.NER_RULES:
        found = F.filter(group_spans(text, before, P.NER_NAME, after, flags), lambda m: F.length(m["matched"]) > 3)
        parts.append(_tagged(found, prio + len(parts), category="name", label=label, suggestion=P.NAME_MASK))
    stop = F.array(*map(F.lit, P.NER_C_STOP))
    loud = F.filter(
        spans(text, P.NER_C), lambda m: (F.size(F.split(m["matched"], r"\s+")) >= 2) & ~F.arrays_overlap(F.split(m["matched"], r"\s+"), stop)
    )
    parts.append(_tagged(loud, prio + len(parts), category="name", label=P.NER_C_LABEL, suggestion=P.NAME_MASK))
    return _all(parts)


def scan(text: Column, patterns: Sequence[P.Pattern] = P.SCAN, extra: Sequence[P.Pattern] = (), name_rule: tuple[str, str, str] | None = P.NAME_RULE, ner: bool = False) -> Column:
    """Findings of patterns, extra patterns, the name rule and, if asked for, the NER rules."""
    every = [*patterns, *extra]

    def found(text: Column, digits: Column) -> Column:
        parts = [_tagged(spans(text, p.source, p.flags, digits), k, category=p.kind, label=p.label, suggestion=p.mask) for k, p in enumerate(every)]
        if name_rule:
            names = F.filter(group_spans(text, *name_rule, digits=digits), lambda m: F.length(m["matched"]) > 3)
            parts.append(_tagged(names, len(parts), category="name", label=P.NAME_LABEL, suggestion=P.NAME_MASK))
        if ner:
            parts.append(ner_findings(text, len(parts)))
        return disjoint(_all(parts), _FINDING_FIELDS)

    return F.coalesce(bound(text, found), F.array().cast(FINDING))


def _valid(name: str):
    return lambda m: VALIDATORS[name](m["matched"])


def scan_offline(text: Column, extra: Column | None = None) -> Column:
    """Check-digit engine: validated matches and external spans (key, label, start, end)."""

    def found(text: Column, digits: Column) -> Column:
        parts = []
        for k, p in enumerate(P.OFFLINE):
            hits = spans(text, p.source, p.flags, digits)
            if p.validator:
                hits = F.filter(hits, _valid(p.validator))
            parts.append(_tagged(hits, k, category=p.key, label=p.label, suggestion=p.id))
        if extra is not None:
            parts.append(
                F.transform(
                    F.coalesce(extra, F.array().cast("array<struct<key:string,label:string,start:int,end:int>>")),
                    lambda m: F.struct(
                        m["start"].alias("start"), m["end"].alias("end"), F.lit(len(parts)).alias("prio"), F.substring(text, m["start"] + 1, m["end"] - m["start"]).alias("matched"),
                        F.coalesce(m["key"], F.lit("NOME")).alias("category"), F.coalesce(m["label"], F.lit("Externo")).alias("label"), F.lit("ext").alias("suggestion"),
                    ),
                )
            )
        return disjoint(_all(parts), _FINDING_FIELDS)

    return F.coalesce(bound(text, found), F.array().cast(FINDING))


def model_spans(text: Column, scored: Column, threshold: float = 0.2, label_map: dict[str, tuple[str, str]] | None = None) -> Column:
    """Spans of a name model as external spans of ``scan_offline``. ``scored``: array<struct<label:string,
    start:int,end:int,score:double>>, as a pandas UDF of the caller's model returns it. Spans below the
    threshold, outside the text, or with a label that the map doesn't have are left out."""
    names = label_map or {"person": ("NOME", "Nome")}
    keys = F.create_map(*[F.lit(x) for label, (key, _) in names.items() for x in (label, key)])
    labels_ = F.create_map(*[F.lit(x) for label, (_, shown) in names.items() for x in (label, shown)])
    good = F.filter(
        F.coalesce(scored, F.array().cast("array<struct<label:string,start:int,end:int,score:double>>")),
        lambda m: (m["score"] >= threshold) & (m["start"] >= 0) & (m["end"] > m["start"]) & (m["end"] <= F.length(text)) & m["label"].isin(*names),
    )
    return F.transform(good, lambda m: F.struct(keys[m["label"]].alias("key"), labels_[m["label"]].alias("label"), m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end")))


def is_public_safe(text: Column) -> Column:
    return F.size(scan(text)) == 0


def labels(findings: Column) -> Column:
    """Distinct labels in first-seen order, comma-joined."""
    return F.array_join(F.array_distinct(F.transform(findings, lambda f: f["label"])), ", ")


def pii_summary(findings: Column) -> Column:
    n = F.size(findings)
    return F.when(n == 0, "Nenhum dado sensível detectado.").otherwise(F.concat(F.lit("Detectamos "), n.cast("string"), F.lit(" dado(s) sensível(is): "), labels(findings), F.lit(".")))
