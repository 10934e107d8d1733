"""MinHash near-dedup with sequential Bayesian verification.

1. Each document becomes a set of two-word shingles, a MinHash signature of 216
   values and a digest of its set. Documents of equal sets are one node, so a
   hot group of copies is one node from here on.
2. 36 bands of 6 values: a pair at the threshold shares a band with probability
   1 - 2e-5. Members of a bucket are compared with hubs instead of each other, and
   what no hub settles by an exact filter on differences (``near.link``).
3. A candidate's signatures are compared 36 values at a time. After each batch
   the pair is dropped if the posterior probability that its similarity reaches
   the threshold is below ``MISS``; survivors are confirmed on their full sets.
4. Links become components; the smallest doc_id of a component stays.

Defined results: ids are integers. Null text and text without words have an empty set
and are linked with nothing; a single word is its own shingle; rows that share a doc_id
are judged each by its own text; a null doc_id is no smallest id unless its group has no
other, and isn't kept beside one; an empty table gives an empty result; other columns are
not read. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm.common import documents, drop_written, written
from sentinela.llm.near import Linker, band_keys, link, signatures, tune

WIDTH = 2
THRESHOLD = (80, 100)  # as a fraction, so that the exact test is in integers
ROWS = 6
BANDS = tune(0.8, 1 - 2e-5, ROWS)
BATCH = 36
MISS = 1e-6


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD,
    rows: int = ROWS, bands: int = BANDS, batch: int = BATCH, miss: float = MISS,
) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept."""
    every = written(signatures(docs, id_col, text_col, width, bands * rows), "signatures")
    ref = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("ref")
    sets = every.where("digest IS NOT NULL").groupBy("digest").agg(ref, F.first("sig").alias("sig"), F.first("n").alias("n"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("ref.id").alias("id"), F.col("ref.th").alias("th"), "n", "sig"), "sets")
    # The hash finds the text; the id only tells texts of one hash apart.
    at = [F.coalesce(F.col("id"), F.lit(0)).alias("i"), "th"]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).select(*at, "text")
    linker = Linker(sets.select("node", "n", "sig", *at), texts, ["i", "th"], width, threshold, batch, miss)
    comp = link(sets.select("node", F.explode(band_keys(F.col("sig"), rows, bands)).alias("key")), linker)
    named = sets.select("digest", F.col("id").alias("component"))
    if comp is not None:
        own = sets.select("node", "digest", "id").join(comp, "node", "left")
        low = own.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("low"))
        named = own.join(low, "component", "left").select("digest", F.coalesce("low", "id").alias("component"))
    named = written(named, "named")
    drop_written(sets)
    return every.select("id", "n", "digest").join(named, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a
), c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
