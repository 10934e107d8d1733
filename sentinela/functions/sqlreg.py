"""SQL access: scalar SQL functions and a table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.operators import mask, scan


def register_view(df: DataFrame, name: str, text_col: str = "text") -> None:
    """A view with the columns of ``df`` and findings, masked, public_safe and sensitivity;
    SQL that doesn't select one of them doesn't compute it."""
    found = scan.scan(F.coalesce(F.col(text_col), F.lit("")))
    view = df.withColumn("findings", found)
    view = view.withColumns({
        "masked": mask.sanitize(F.coalesce(F.col(text_col), F.lit("")), F.col("findings")),
        "public_safe": F.size("findings") == 0,
        "sensitivity": mask.sensitivity(F.col("findings")),
    })
    view.createOrReplaceTempView(name)


def findings_table(spark: SparkSession, view: str, id_col: str) -> DataFrame:
    """One row for each finding of a registered view."""
    return spark.sql(f"SELECT `{id_col}`, f.* FROM `{view}` LATERAL VIEW explode(findings) t AS f")
