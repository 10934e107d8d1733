"""Rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each document. The ledger keeps the
measurements and one failure bit for each rule, and is stored (``stored_ledger``); a policy is
a bitmask with a version, so verdicts and ablations need no second pass over the texts:
``verdict`` is ``failures & mask = 0`` and ``ablation`` gives, for each rule, the documents it
fails, those only it fails, and the rules that fail with it: bit_or over the documents it
fails has every rule that ever does, bit_and those that always do. Nothing is shuffled to
build the ledger.

Defined results: null and empty texts have no words, all measures are 0 and the
word-count rule fails; an empty table gives an empty ledger; a repeated row is
judged on its own; other columns are not read. Windows of three words are
compared by their 64-bit hash within one document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm.common import documents, words_of, written

#: Rules by bit. A rule is a failure condition on the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("few_letters", "5 * n_alpha_words < 2 * n_words"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("open_ends", "n_lines >= 4 AND 10 * n_end_lines < n_lines"),
    ("many_words", "n_words > 100000"),
)
BASE_BITS = 0b11
#: Measurements of lines: (name, pattern of a line). The patterns mean the same in Java and RE2.
LINE_KINDS: tuple[tuple[str, str], ...] = (
    ("n_bullet_lines", r"^[\x20\x09-\x0D]*[-*•‣▪]"),
    ("n_ellipsis_lines", r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"),
    ("n_end_lines", r"[.!?:;…][\"'»”)]*[\x20\x09-\x0D]*$"),
)


@dataclass(frozen=True)
class Policy:
    """A named version of which rules count."""

    version: str
    mask: int


BASE_POLICY = Policy("base-1", BASE_BITS)
PRODUCTION = Policy("production-2", 0b101111111)
STRICT = Policy("strict-1", (1 << len(RULES)) - 1)


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def _window_hashes(words: Column) -> Column:
    """Hash of every run of three words; none where no run could occur twice."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
    )
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias(id_col), text.alias("_t"), words_of(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.select(
        id_col,
        "_w",
        lines.alias("_lines"),
        _window_hashes(F.col("_w")).alias("_h"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    a = a.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        *[F.size(F.filter("_lines", _like(pattern))).cast("long").alias(name) for name, pattern in LINE_KINDS],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h"))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    # Sorted by hash, equal windows are neighbours; their places, sorted, give the words covered.
    a = a.withColumn("_s", F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"])
    a = a.withColumn(
        "_p", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"]))
    )
    step = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    return a.withColumn(
        "n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    ).drop("_h", "_s", "_p")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and the failure bits of every rule."""
    bits = None
    for k, (_, fails) in enumerate(RULES):
        bit = F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, id_col, text_col).withColumn("failures", bits)


def verdict(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Apply a policy to a ledger: policy_version and kept."""
    return rows.withColumn("policy_version", F.lit(policy.version)).withColumn(
        "kept", F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0
    )


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table in the shared folder: a filter on its columns doesn't evaluate the rules again."""
    return written(ledger(docs, id_col, text_col), "ledger")


def ablation(rows: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """One row for each rule of the policy: policy_version, rule, failed, failed_alone (the documents that
    removing the rule would keep as well), ever_with and always_with (bits of the other rules of the policy)."""
    hit = F.col("failures").bitwiseAND(F.lit(policy.mask))
    counted = rows.groupBy(hit.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules groups
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, (name, _) in enumerate(RULES) if policy.mask >> k & 1])
    # A row for each rule even if nothing fails it.
    each = counted.withColumn("r", F.explode(rules)).select("r.rule", "r.bit", "bits", "n")
    none = rows.sparkSession.range(1).select(F.explode(rules).alias("r")).select("r.rule", "r.bit", F.lit(0).alias("bits"), F.lit(0).cast("long").alias("n"))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.when(fails, F.col("bits").bitwiseXOR(F.col("bit")))
    return each.union(none).groupBy(F.lit(policy.version).alias("policy_version"), "rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.coalesce(F.bit_or(others), F.lit(0)).alias("ever_with"),
        F.coalesce(F.bit_and(others), F.lit(0)).alias("always_with"),
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(stored_ledger(documents(spark, sf_dir)), STRICT)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(stored_ledger(documents(spark, sf_dir))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(BASE_BITS)) != 0).alias("base_failed"),
        "kept",
        "failures",
    )


def _ledger_sql() -> str:
    lines = ", ".join("len(list_filter(ls, lambda x: regexp_matches(x, '" + p.replace("'", "''") + f"'))) AS {name}" for name, p in LINE_KINDS)
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT doc_id, t, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_alpha_words,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 3
), k AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM k) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), a AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, n_alpha_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(ls) AS n_lines, {lines}, coalesce(cov.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id
), f AS (
  SELECT *, CAST({bits} AS INTEGER) AS failures FROM a
)"""


ORACLE = _ledger_sql() + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & {BASE_BITS} <> 0 AS base_failed, failures & {PRODUCTION.mask} = 0 AS kept, failures
FROM f
"""
_RULE_ROWS = ", ".join(f"('{name}', {1 << k})" for k, (name, _) in enumerate(RULES))
ABLATION_ORACLE = _ledger_sql() + f""", r(rule, bit) AS (VALUES {_RULE_ROWS})
SELECT '{STRICT.version}' AS policy_version, rule, count(*) FILTER (WHERE failures & bit <> 0) AS failed,
       count(*) FILTER (WHERE failures = bit) AS failed_alone,
       CAST(coalesce(bit_or(xor(failures, bit)) FILTER (WHERE failures & bit <> 0), 0) AS INTEGER) AS ever_with,
       CAST(coalesce(bit_and(xor(failures, bit)) FILTER (WHERE failures & bit <> 0), 0) AS INTEGER) AS always_with
FROM f CROSS JOIN r GROUP BY rule
"""
