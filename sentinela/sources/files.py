"""Text sources and vault files."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs of a .docx file, two line breaks between them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))

    def of(p: ElementTree.Element) -> str:
        parts = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
        return "".join(parts[n.tag](n) for n in p.iter() if n.tag in parts)

    return "\n\n".join(of(p) for p in body.iter(f"{_W}p"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): .txt, .md and .csv whole, .docx as raw text. PDF needs a library that
    isn't here; any other extension is an error, raised when the row is read. Each file is read once."""

    @F.pandas_udf("string")
    def from_docx(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else docx_text(x))

    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    plain = F.when(ext.isin("txt", "md", "csv"), F.decode("content", "UTF-8"))
    other = F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path"))).cast("string")
    docx = from_docx(F.when(ext == "docx", F.col("content")))  # Python gets the bytes of .docx files only
    return files.withColumn("from_docx", docx).select("path", plain.when(ext == "docx", F.col("from_docx")).otherwise(other).alias("text"))


def write_vault(vault: DataFrame, path: str) -> None:
    """vault (doc_id, token, original) as JSON lines; an empty vault is refused."""
    if vault.isEmpty():
        raise ValueError("the vault is empty")
    vault.write.json(path)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("doc_id long, token string, original string").json(path)
    return rows.where("token IS NOT NULL AND original IS NOT NULL")


def parse_vault(text: str) -> dict[str, str]:
    """One exported vault: {tokens: {...}}."""
    tokens = json.loads(text).get("tokens")
    if not isinstance(tokens, dict):
        raise ValueError("vault has no tokens object")
    return tokens


def probe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).limit(1)
