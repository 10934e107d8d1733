"""Masking policy over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela.functions.text import splice
from sentinela.operators import patterns as P
from sentinela.operators.scan import detect_pii, labels

# Banner, disclosure and grading.
BANNER = "[CONTEÚDO BLOQUEADO — DADOS SENSÍVEIS DETECTADOS]"
DISCLOSURE = ("[LGPD] Dados pessoais detectados e mascarados nesta resposta: ", ". Conforme Lei 13.709/2018.")
CRITICAL = ("cpf", "masp", "reds", "rg")
HIGH = ("process_number", "date_of_birth")


def sanitize(text: Column, findings: Column) -> Column:
    return splice(text, findings, lambda f: f["suggestion"])


def partial_mask(pattern_id: Column, matched: Column, mask: Column) -> Column:
    """What stays readable of a match in partial mode."""
    d = F.regexp_replace(matched, "[^0-9]", "")
    cpf = F.when(F.length(d) == 11, F.concat(F.lit("***."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-**")))
    cnpj = F.when(F.length(d) == 14, F.concat(F.lit("**."), F.substring(d, 3, 3), F.lit("."), F.substring(d, 6, 3), F.lit("/****-**")))
    phone = F.when(F.length(d) >= 10, F.concat(F.lit("("), F.substring(d, 1, 2), F.lit(") ****-"), F.substring(d, -4, 4)))
    parts = F.split(matched, "@")
    host = F.get(parts, F.lit(1))
    tail = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    name = F.substring(host, F.lit(1), F.length(host) - F.length(tail))
    email = F.concat(F.substring(F.get(parts, F.lit(0)), 1, 1), F.lit("***@"), F.substring(name, 1, 1), F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(name) - 1)), tail)
    return F.coalesce(F.when(pattern_id == "cpf", cpf).when(pattern_id == "cnpj", cnpj).when(pattern_id == "telefone", phone).when(pattern_id == "email", email), mask)


def mask_pii(text: Column, ids: Sequence[str] | None = None, mode: str = "full") -> Column:
    """Detect and replace the default patterns, or those of ``ids``, whole or in part."""
    chosen = [p for p in P.DEFAULT if ids is None or p.id in ids]
    if not chosen:
        return text
    found = detect_pii(text, chosen)
    if mode == "partial":
        return splice(text, found, lambda m: partial_mask(m["pattern_id"], m["matched"], m["mask_format"]))
    return splice(text, found, lambda m: m["mask_format"])


def sensitivity(findings: Column) -> Column:
    has = lambda kinds: F.exists(findings, lambda f: f["category"].isin(*kinds))
    return F.when(has(CRITICAL), "critical").when(has(HIGH), "high").when(F.size(findings) > 3, "medium").otherwise("low")


def actions(findings: Column, level: Column, critical_action: str = "redact") -> Column:
    """One entry for each category in first-seen order: category, action, count, positions."""
    kinds = F.array_distinct(F.transform(findings, lambda f: f["category"]))
    act = F.when((level == "critical") & F.lit(critical_action == "block"), "block").otherwise("redact")

    def entry(kind: Column) -> Column:
        own = F.filter(findings, lambda f: f["category"] == kind)
        return F.struct(
            kind.alias("category"), act.alias("action"), F.size(own).alias("count"), F.transform(own, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))).alias("positions")
        )

    return F.transform(kinds, entry)


def masked(text: Column, findings: Column, mode: str = "full", critical_action: str = "redact", strict: bool = False) -> Column:
    """The public text. Partial mode re-runs the default patterns, so names, birth dates and
    custom patterns stay readable; ``strict`` masks them as well."""
    if mode == "partial" and not strict:
        out = mask_pii(text, None, "partial")
    elif mode == "partial":
        ids = {p.kind: p.id for p in P.DEFAULT}
        as_id = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
        out = splice(text, findings, lambda f: partial_mask(as_id[f["category"]], f["matched"], f["suggestion"]))
    else:
        out = sanitize(text, findings)
    if critical_action == "block":
        out = F.when(sensitivity(findings) == "critical", BANNER).otherwise(out)
    return out


def disclosure(findings: Column) -> Column:
    return F.when(F.size(findings) == 0, "").otherwise(F.concat(F.lit(DISCLOSURE[0]), labels(findings), F.lit(DISCLOSURE[1])))
