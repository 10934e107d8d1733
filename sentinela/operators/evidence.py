"""Evidence chains: claims, their confidence, the hash that seals them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence names by rank.
RANKS = {"certain": 5, "high": 4, "medium": 3, "low": 2, "speculative": 1}
EVIDENCE = "struct<id:string,type:string,source:string,content:string,confidence:string,timestamp:string>"
CLAIM = f"struct<claim:string,evidence:array<{EVIDENCE}>,confidence:string,verifiable:boolean>"


def rank(confidence: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[confidence]


def named(r: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (v, k)])[r]


def lowest(levels: Column) -> Column:
    """Lowest of an array of confidences; an empty one is speculative."""
    return named(F.coalesce(F.array_min(F.transform(levels, rank)), F.lit(1)))


def evidence(kind: str, source: Column, content: Column, confidence: Column, at: Column, id_: Column | None = None) -> Column:
    return F.struct(
        (id_ if id_ is not None else F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", source, content).cast("binary"), 256), 1, 12))).alias("id"),
        F.lit(kind).alias("type"), source.alias("source"), content.alias("content"), confidence.alias("confidence"), at.alias("timestamp"),
    ).cast(EVIDENCE)


def claim(text: Column, items: Column, confidence: Column | None = None) -> Column:
    low = lowest(F.transform(items, lambda e: e["confidence"]))
    return F.struct(
        text.alias("claim"), items.alias("evidence"), (low if confidence is None else F.coalesce(confidence, low)).alias("confidence"), F.exists(items, lambda e: e["type"] != "inference").alias("verifiable")
    ).cast(CLAIM)


def tool_claim(text: Column, tool: Column, result: Column, at: Column, confidence: str = "high") -> Column:
    return claim(text, F.array(evidence("tool_call", tool, result, F.lit(confidence), at)), F.lit(confidence))


def document_claim(text: Column, source: Column, excerpt: Column, at: Column, confidence: Column | None = None) -> Column:
    level = F.lit("high") if confidence is None else F.coalesce(confidence, F.lit("high"))
    return claim(text, F.array(evidence("document", source, excerpt, level, at)), level)


def audit_hash(response_id: Column, created_at: Column, claims: Column) -> Column:
    sealed = F.to_json(
        F.struct(
            response_id.alias("responseId"), created_at.alias("createdAt"),
            F.transform(claims, lambda c: F.struct(c["claim"].alias("claim"), c["confidence"].alias("confidence"))).alias("claims"),
        )
    )
    return F.concat(F.lit("ev-"), F.sha2(sealed.cast("binary"), 256))


def chain(response_id: Column, created_at: Column, claims: Column, session_id: Column | None = None) -> Column:
    """The identifier and the time are given, not taken from a clock or a counter."""
    return F.struct(
        response_id.alias("responseId"), (session_id if session_id is not None else F.lit(None).cast("string")).alias("sessionId"), created_at.alias("createdAt"), claims.alias("claims"),
        lowest(F.transform(claims, lambda c: c["confidence"])).alias("overallConfidence"), audit_hash(response_id, created_at, claims).alias("auditHash"),
    )


def block(c: Column) -> Column:
    """Readable citation block of a chain."""
    lines = F.transform(
        c["claims"],
        lambda x: F.concat(
            F.array(F.concat(F.lit("• "), x["claim"], F.lit(" (confiança: "), x["confidence"], F.lit(")"))),
            F.transform(x["evidence"], lambda e: F.concat(F.lit("  ↳ ["), e["type"], F.lit("] "), e["source"], F.lit(': "'), F.substring(e["content"], 1, 120), F.lit('..."'))),
        ),
    )
    head = F.array(F.concat(F.lit("[Evidências — "), c["responseId"], F.lit("]")))
    return F.array_join(F.concat(head, F.flatten(lines), F.array(F.concat(F.lit("Audit hash: "), c["auditHash"]))), "\n")


def valid(c: Column, least: str = "low") -> Column:
    return rank(c["overallConfidence"]) >= RANKS[least]
