"""Reversible tokenization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.functions.text import splice
from sentinela.operators import patterns as P

ENTRIES = "array<struct<token:string,original:string>>"


def opaque_token(category: Column, value: Column, seed: str) -> Column:
    digest = F.sha2(F.concat(F.lit(seed + "|"), value).cast("binary"), 256)
    return F.concat(F.lit("[PII:"), F.upper(category), F.lit(":"), F.substring(digest, 1, 8), F.lit("]"))


def tokenize(text: Column, findings: Column, seed: str) -> tuple[Column, Column, Column]:
    """(tokenized text, vault entries, audit rows from right to left). The seed is explicit,
    so a repeated task gives the same tokens."""
    token = lambda f: opaque_token(f["category"], f["matched"], seed)
    back = F.reverse(findings)
    vault = F.array_distinct(F.transform(back, lambda f: F.struct(token(f).alias("token"), f["matched"].alias("original"))))
    audit = F.transform(back, lambda f: F.struct(token(f).alias("token"), f["category"].alias("category"), f["label"].alias("label")))
    return splice(text, findings, token), vault, audit


def restore(text: Column, entries: Column) -> Column:
    """Every token replaced by its original, in vault order."""
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["token"], e["original"]))


def has_tokens(text: Column, entries: Column) -> Column:
    return F.exists(entries, lambda e: F.contains(text, e["token"]))


def category_key(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in P.KEYS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, category), F.regexp_replace(F.upper(category), "[^A-Z0-9]", ""))


def _number(n: Column) -> Column:
    return F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0"))


def named_entries(findings: Column, is_key: bool = False) -> Column:
    """Vault of [KEY_0001] tokens, numbered by key from the end of the text; one token for
    each original, under the key of its right-most finding."""
    key = (lambda f: f["category"]) if is_key else (lambda f: category_key(f["category"]))
    start = F.array().cast("array<struct<key:string,original:string,n:int>>")

    def step(acc: Column, f: Column) -> Column:
        k = key(f)
        n = F.size(F.filter(acc, lambda e: e["key"] == k)) + 1
        new = F.struct(k.alias("key"), f["matched"].alias("original"), n.alias("n"))
        return F.when(F.exists(acc, lambda e: e["original"] == f["matched"]), acc).otherwise(F.concat(acc, F.array(new)))

    return F.transform(
        F.aggregate(F.reverse(findings), start, step),
        lambda e: F.struct(F.concat(F.lit("["), e["key"], F.lit("_"), _number(e["n"]), F.lit("]")).alias("token"), e["original"].alias("original")),
    )


def named_tokenize(text: Column, findings: Column, entries: Column) -> Column:
    return splice(text, findings, lambda f: F.filter(entries, lambda e: e["original"] == f["matched"])[0]["token"])


def named_vault(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same vault from exploded findings (id, category, start, matched), for vault tables."""
    last = found.groupBy(id_col, "matched").agg(F.max("start").alias("at"), F.max_by("category", "start").alias("category"))
    last = last.withColumn("key", category_key(F.col("category")))
    n = F.row_number().over(Window.partitionBy(id_col, "key").orderBy(F.desc("at")))  # one document's values
    return last.select(id_col, F.concat(F.lit("["), "key", F.lit("_"), _number(n), F.lit("]")).alias("token"), F.col("matched").alias("original"))


def restore_counted(text: Column, entries: Column) -> tuple[Column, Column]:
    """Longest token first; the text and how many tokens changed it."""
    ordered = F.transform(F.array_sort(F.transform(entries, lambda e: F.struct((-F.length(e["token"])).alias("k"), e["token"].alias("token"), e["original"].alias("original")))), lambda e: e)
    state = F.aggregate(
        ordered,
        F.struct(text.alias("t"), F.lit(0).alias("n")),
        lambda acc, e: F.struct(F.replace(acc["t"], e["token"], e["original"]).alias("t"), (acc["n"] + F.contains(acc["t"], e["token"]).cast("int")).alias("n")),
    )
    return state["t"], state["n"]


def stats_by_key(entries: DataFrame, token_col: str = "token") -> DataFrame:
    return entries.groupBy(F.regexp_extract(token_col, r"^\[([A-Z0-9]+)_", 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
