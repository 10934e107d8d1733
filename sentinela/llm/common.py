"""Shared helpers: the shared folder, written intermediate tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the contracts, as a regex class.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed value: a word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


_MADE: list[str] = []  # folders that ``written`` has made
#: Rows of a few numbers each (at most 40 bytes) that may be broadcast; above it Spark shuffles.
MOST_BROADCAST = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; a local session without one
    (as in tests) gets a folder of its own. A cluster that names none is an error,
    as its machines would each write to their own disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sentinela-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives a lost executor, which a cached or
    locally checkpointed frame does not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sentinela/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The folders that ``written`` has made in this driver, in order."""
    return list(_MADE)


def sweep(spark: SparkSession, folders: list[str], keep: DataFrame) -> None:
    """Delete folders that ``written`` has made, but for the files of ``keep``."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[-1] not in kept:
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``written``."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def few_joined(df: DataFrame, keys: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """``df`` joined with narrow rows, which are broadcast if they are counted to be few."""
    return df.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, list(on), how)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a like one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge: (node, component).

    Alternating large-star and small-star steps: every round is two groupings
    of the edge list, each written to the shared folder, until it is a set of
    stars. No neighbourhood is gathered: the minimum of a node is a plain
    aggregate, joined back to the edges.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # Large star: link every larger neighbour of a node to the node's minimum.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # Small star: link every smaller neighbour, and the node, to the minimum.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        nxt = written(small, "stars")
        # Settled when every node hangs on one centre and no centre hangs on another.
        centres = nxt.select(F.col("v").alias("n"), F.lit(0).alias("up"))
        ups = nxt.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(centres.distinct())
        done = ups.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
        drop_written(e)
        e = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
