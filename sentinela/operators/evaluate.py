"""Precision, recall and F1 of the scan on labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.operators.scan import scan

# Category to tracked pattern, tracked patterns, verdict tiers.
TRACKED_BY_CATEGORY = {"cpf": "cpf", "cnpj": "cnpj", "rg": "rg", "cnh": "cnh", "masp": "masp", "reds": "reds", "process_number": "processo", "plate": "placa_antiga", "phone": "telefone", "email": "email", "cep": "cep", "health_data": "health_condition"}
TRACKED = ("cpf", "cnpj", "rg", "cnh", "masp", "reds", "processo", "placa_antiga", "telefone", "email", "cep")
TIERS = ((0.9, "competitive"), (0.8, "adequate"))


def detected(text: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in TRACKED_BY_CATEGORY.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(scan(text), lambda f: F.try_element_at(by, f["category"])), lambda p: p.isNotNull()))


def cases(df: DataFrame) -> DataFrame:
    """df (case_id, text, expected): detected, missed, extra, perfect."""
    d = df.withColumn("detected", detected(F.col("text")))
    return d.withColumn("missed", F.array_except("expected", "detected")).withColumn("extra", F.array_except("detected", "expected")).withColumn("perfect", (F.size("missed") == 0) & (F.size("extra") == 0))


def by_pattern(evaluated: DataFrame) -> DataFrame:
    """pattern, tp, fp, fn, precision, recall, f1; patterns without any case are left out."""
    side = lambda kind, arr: F.transform(arr, lambda p: F.struct(p.alias("pattern"), F.lit(kind).alias("kind")))
    rows = evaluated.select(F.explode(F.concat(side("tp", F.array_intersect("expected", "detected")), side("fp", F.col("extra")), side("fn", F.col("missed")))).alias("r")).select("r.*").where(F.col("pattern").isin(*TRACKED))
    n = rows.groupBy("pattern").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    n = n.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
    total = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


def macro(evaluated: DataFrame) -> DataFrame:
    m = by_pattern(evaluated).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    share = evaluated.agg((100.0 * F.count_if("perfect") / F.count(F.lit(1))).alias("perfect_pct"))
    tier = F.when(F.col("f1") >= TIERS[0][0], TIERS[0][1]).when(F.col("f1") >= TIERS[1][0], TIERS[1][1]).otherwise("needs work")
    return m.crossJoin(share).withColumn("verdict", tier)  # one row each
