"""Exact dedup over an extendible-hash index on shared files (DataFrame functions only).

1. Every row becomes an index entry (64-bit key, digest, length of the normalised text)
   that is written to the shared folder; texts are normalised once and stay where they are.
2. The directory doubles until no bucket holds more than ``bucket_entries`` different
   entries; there is no fixed depth. A bucket is a range of keys. The directory has about
   entries / ``bucket_entries`` slots, and only the histogram of key prefixes reaches the driver.
3. Entries of one key and digest are combined before they are moved, so a hot text is a row
   for each map task. Owner tasks take the buckets by range, order each key's chain, and
   write the index: link, survivor, group size.
4. Only keys met more than once need their bytes: those rows are read again, and copies
   combine as equal bytes before the shuffle. A chain link whose rows differ is an error.
5. Each entry finds its link through the directory: key prefix, bucket, key, digest. Spark can
   split a hot key on the entry side.

Defined results: ids are integers. Null text counts as empty; all empty or blank texts are equal;
a null ``doc_id`` ranks behind every other id; of rows repeated whole, exactly one
is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.llm.common import MOST_BROADCAST, SPACE, documents, few_joined, written

LINK = ["key", "sha", "n_body"]


def _bare(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", "")


def entries_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Index entries: id, uid, code points, hash of the text as it is, key, digest, length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("uid"),
        F.length(text).alias("n_cp"),
        F.xxhash64(text).alias("raw"),
        _bare(text_col).alias("body"),
    )
    return base.select("id", "uid", "n_cp", "raw", F.xxhash64("body").alias("key"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"), F.octet_length("body").alias("n_body"))


def _cell(depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def split_directory(cells: dict[int, int], depth: int, bucket_entries: int) -> list[tuple[int, int, int]]:
    """Buckets as (first cell, last cell, local depth), in key order: the largest aligned
    ranges of cells with at most ``bucket_entries`` entries. ``cells``: entries by prefix."""
    at = sorted(cells)
    total = [0]
    for c in at:
        total.append(total[-1] + cells[c])
    buckets, todo = [], [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        width = 1 << (depth - local)
        low = prefix * width
        held = total[bisect_left(at, low + width)] - total[bisect_left(at, low)]
        if held > bucket_entries and local < depth:
            todo += [(prefix * 2 + 1, local + 1), (prefix * 2, local + 1)]
        else:
            buckets.append((low, low + width - 1, local))
    return buckets


class Directory:
    """Key prefixes to buckets. Its size is about entries / bucket_entries."""

    def __init__(self, links: DataFrame, bucket_entries: int):
        self.depth = max(0, (links.count() // bucket_entries).bit_length() - 1)
        while True:
            cells = {r["cell"]: r["n"] for r in links.groupBy(_cell(self.depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each prefix
            if self.depth == 60 or max(cells.values(), default=0) <= bucket_entries:
                break
            self.depth += 1
        self.buckets = split_directory(cells, self.depth, bucket_entries)
        slots = [(c, b, local) for b, (low, high, local) in enumerate(self.buckets) for c in range(low, high + 1)]
        self.slots = links.sparkSession.createDataFrame(slots, "cell bigint, bucket int, local_depth int")
        self.few = len(slots) <= MOST_BROADCAST

    def find(self, rows: DataFrame) -> DataFrame:
        """The rows with the bucket of their key."""
        return rows.withColumn("cell", _cell(self.depth)).join(F.broadcast(self.slots) if self.few else self.slots, "cell").drop("cell")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 20_000, row_col: str | None = None) -> tuple[DataFrame, Directory, DataFrame]:
    """(entries, directory, index). ``index``: one row for each distinct text, in bucket order:
    bucket, local_depth, key, link (place in the key's chain), sha, n_body, n, and the
    survivor: keep_id, keep_uid."""
    entries = written(entries_of(docs, id_col, text_col, row_col), "entries")
    # Longest original text, then smallest id, then one of rows repeated whole.
    best = F.max(F.struct("n_cp", F.col("id").isNotNull().alias("has"), (-F.col("id")).alias("neg"), (-F.col("uid")).alias("nuid"))).alias("best")
    links = written(entries.groupBy(*LINK).agg(best, F.count(F.lit(1)).alias("n")), "links")
    directory = Directory(links, bucket_entries)
    # The bytes of what was met more than once.
    again = written(entries.join(links.where("n > 1").select(*LINK), LINK, "left_semi").select("raw").distinct(), "again")
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("raw"), F.col(text_col).alias("text"))
    bodies = few_joined(rows, again, "raw", how="left_semi").select(_bare("text").alias("body"))
    bodies = bodies.groupBy("body").agg(F.count(F.lit(1)).alias("rows"))
    bodies = bodies.select(F.xxhash64("body").alias("key"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"), F.octet_length("body").alias("n_body"), "rows")
    compared = bodies.groupBy(*LINK).agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows"))
    same = (F.col("n") == 1) | ((F.col("texts") == 1) & (F.col("rows") == F.col("n")))
    size = F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("texts of different bytes share key, digest and length")).cast("long"))
    checked = links.join(compared, LINK, "left").select(*LINK, size.alias("n"), (-F.col("best.neg")).alias("keep_id"), (-F.col("best.nuid")).alias("keep_uid"))
    owned = directory.find(checked).repartitionByRange("bucket")
    chained = owned.withColumn("link", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("sha", "n_body")) - 1)
    return entries, directory, written(chained.sortWithinPartitions("bucket", "key", "link"), "index")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 20_000, row_col: str | None = None) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256, bucket, link,
    and ``row_col``, if the rows have a number of their own (bigint, no two equal)."""
    entries, directory, index = build_index(docs, id_col, text_col, bucket_entries, row_col)
    return directory.find(entries).drop("local_depth").join(index, ["bucket", *LINK]).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "link",
        *([F.col("uid").alias(row_col)] if row_col else []),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents
), r AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER (PARTITION BY body ORDER BY n_cp DESC, doc_id) AS rn
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(body) AS text_sha256 FROM r
"""
