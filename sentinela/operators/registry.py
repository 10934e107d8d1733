"""Institution profiles and human review."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.operators.patterns import PROFILE_PCMG, Pattern
from sentinela.operators.scan import scan


def profile_json(profile_id: str, name: str, patterns: Sequence[Pattern], **more: str) -> str:
    """A profile as one self-contained JSON document."""
    rows = [
        {"id": p.id, "label": p.label, "regex": p.source, "flags": p.flags, "maskFormat": p.mask, "confidence": p.confidence, "hitlStats": {"confirmations": p.hitl[0], "rejections": p.hitl[1]}} for p in patterns
    ]
    return json.dumps({"id": profile_id, "name": name, **more, "patterns": rows}, ensure_ascii=False)


def read_profile(text: str) -> tuple[Pattern, ...]:
    def one(p: dict) -> Pattern:
        if ":" not in p["id"]:
            raise ValueError(f"custom pattern id {p['id']!r} needs a namespace")
        h = p.get("hitlStats") or {}
        return Pattern(p["id"], p["label"], p["regex"], p.get("flags", "g"), p["maskFormat"], p.get("confidence", "low"), hitl=(h.get("confirmations", 0), h.get("rejections", 0)))

    return tuple(map(one, json.loads(text)["patterns"]))


def patterns_table(spark: SparkSession, patterns: Sequence[Pattern]) -> DataFrame:
    rows = [(p.id, p.label, p.source, p.flags, p.mask, p.confidence, *p.hitl) for p in patterns]
    return spark.createDataFrame(rows, "id string, label string, regex string, flags string, mask_format string, confidence string, confirmations int, rejections int")


def hitl_matches(corpus: DataFrame, patterns: Sequence[Pattern] = PROFILE_PCMG) -> DataFrame:
    """corpus (id, pattern_id, text, should_match): the findings of the row's own pattern;
    a row that should match and doesn't gives one row with found = false."""
    found = F.filter(scan(F.col("text"), extra=patterns), lambda f: f["category"] == F.col("pattern_id"))
    rows = corpus.withColumn("f", F.explode_outer(found))
    rows = rows.withColumn("found", F.col("f").isNotNull()).where("found OR should_match")
    no = F.when(F.col("found"), F.row_number().over(_by_row())).otherwise(F.lit(0))
    return rows.select("id", "pattern_id", "text", "should_match", "found", no.alias("finding_no"), F.coalesce("f.matched", F.lit("")).alias("matched"))


def _by_row():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("f.start")  # one sentence's findings


def decision(answer: Column) -> Column:
    """Reviewer input: s or nothing confirms, n rejects, p is partial, anything else skips."""
    a = F.lower(F.trim(answer))
    return F.when(a.isin("s", ""), "confirmed").when(a == "n", "rejected").when(a == "p", "partial").otherwise("skipped")


def session_summary(reviewed: DataFrame) -> DataFrame:
    """reviewed (should_match, decision): counts of a session. ``false_positives`` counts
    rejected rows that were expected, as the session format has it."""
    count = lambda cond, name: F.count_if(cond).alias(name)
    d = F.col("decision")
    return reviewed.agg(
        F.count(F.lit(1)).alias("total_matches"), count(d == "confirmed", "confirmed"), count(d == "rejected", "rejected"), count(d == "partial", "partial"), count((d == "rejected") & F.col("should_match"), "false_positives")
    )


def write_session(reviewed: DataFrame, profile_id: str, run_at: str, path: str) -> None:
    """A review session as one JSON document: profile, runAt, the counts and the decisions, which are as
    many as a person has taken. ``reviewed``: id, pattern_id, text, should_match, matched, decision."""
    counts = session_summary(reviewed)
    names = {"total_matches": "totalMatches", "false_positives": "falsePositives"}
    entry = F.struct(F.col("pattern_id").alias("patternId"), F.col("id").alias("corpusId"), F.col("matched").alias("matchedText"), F.col("text").alias("fullText"), F.col("should_match").alias("shouldMatch"), F.col("decision").alias("reviewerDecision"))
    rows = reviewed.agg(F.sort_array(F.collect_list(entry)).alias("results"))
    head = counts.select(F.lit(profile_id).alias("profile"), F.lit(run_at).alias("runAt"), *[F.col(c).alias(names.get(c, c)) for c in counts.columns])
    head.crossJoin(rows).coalesce(1).write.json(path)  # one row each


def promoted(confirmations: Column, rejections: Column, current: Column) -> Column:
    total = confirmations + rejections
    return F.when(total == 0, current).when(rejections / total > 0.2, "low").when(confirmations >= 30, "high").when(confirmations >= 10, "medium").otherwise(current)


def highlight(text: Column, matched: Column) -> Column:
    at = F.instr(text, matched)
    return F.when(at > 0, F.overlay(text, F.concat(F.lit(">>>>"), matched, F.lit("<<<<")), at, F.length(matched))).otherwise(text)
