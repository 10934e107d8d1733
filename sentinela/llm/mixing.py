"""Mixing sources to target weights.

Temperature mixing: a source with token share p gets weight p^a / sum(p^a). The
exponent a is bisected on a grid of 2**-20 over [0, 1] (a = 1: as it is, a = 0:
uniform), either to the largest one whose entropy reaches a target or to the
smallest one that repeats no source more often than a limit. Every step is an
aggregation over the table of sources; the driver gets one number for each
candidate exponent, however many sources there are.

The weights are realised under a token budget as block permutations. A source
of t tokens and budget b gives floor(b / t) whole epochs and a part of one more.
In every epoch its documents are dealt to hash blocks (at most ``MAX_BLOCKS`` a
source, so a hot source has bigger blocks and not one big sort), blocks are
permuted, and so are the documents of each block. The last epoch ends with the
last document that fits its budget. Without a budget, the smallest one is taken
at which no document is left out.

Defined results: null source counts as the empty one; null text has no tokens;
sources without tokens are kept once; documents without tokens come with every
whole epoch; repeated rows are documents of their own; an empty table gives an
empty plan; other columns aren't read by ``plan`` and are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.llm.common import documents, few_joined, fresh, words_of, written

GRID = 1 << 20
BLOCK_TOKENS = 65_536
MAX_BLOCKS = 4096


def shares(docs: DataFrame, source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """(source, tokens, docs) of every source."""
    tokens = F.size(words_of(F.col("text"))).cast("long") if tokens is None else tokens
    return (
        docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), tokens.alias("n"))
        .groupBy("source")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    )


def _measure(sources: DataFrame, points: list[int], what: str) -> dict[int, float]:
    """Entropy in nats, or the most repetitions, of each candidate exponent."""
    s = sources.where("tokens > 0")
    top = s.agg(F.max("tokens").cast("double").alias("most"), F.sum("tokens").cast("double").alias("all"))
    a = F.col("k") / F.lit(float(GRID))
    rows = s.crossJoin(F.broadcast(top)).select(  # one row on the right
        F.explode(F.array(*map(F.lit, points))).alias("k"),
        (F.col("tokens") / F.col("most")).alias("r"),
    )
    # With r = t / t_max: p^a is proportional to r^a, and at the budget that shows the
    # largest source once, a source is shown r^(a - 1) times.
    z, zl = F.sum(F.pow("r", a)), F.sum(F.pow("r", a) * F.ln("r"))
    value = F.log(z) - F.first(a) * zl / z if what == "entropy" else F.max(F.pow("r", a - 1))
    return {x["k"]: x["v"] for x in rows.groupBy("k").agg(value.alias("v")).collect()}


def bisect_exponent(sources: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, levels: int = 4) -> float:
    """The exponent, as a multiple of 1 / GRID. Each job answers ``levels`` halvings."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give a target entropy or a repetition limit")
    what = "entropy" if max_repetition is None else "repetition"
    good = (lambda v: v >= target_entropy) if what == "entropy" else (lambda v: v <= max_repetition)
    # entropy: good at the low end, wanted is the last good; repetition: the first good.
    low, high = 0, GRID
    ends = _measure(sources, [low, high], what)
    if not ends:
        return 1.0
    if what == "entropy":
        if good(ends[high]):
            return 1.0
        if not good(ends[low]):
            return 0.0
    elif good(ends[low]):
        return 0.0
    while high - low > 1:
        width = high - low
        parts = min(1 << levels, width)
        points = sorted({low + width * j // parts for j in range(1, parts)})
        got = _measure(sources, points, what)
        for _ in range(levels):
            middle = (low + high) // 2
            if middle not in got or high - low <= 1:
                break
            if good(got[middle]) == (what == "entropy"):
                low = middle
            else:
                high = middle
    return (low if what == "entropy" else high) / GRID


def weights(sources: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, weight, budget, epochs, rest, blocks). The table of sources
    is as long as there are sources and stays distributed."""
    a = F.lit(exponent)
    top = sources.where("tokens > 0").agg(F.max("tokens").cast("double").alias("most"))
    s = sources.crossJoin(F.broadcast(top)).withColumn("r", F.col("tokens") / F.col("most"))  # one row on the right
    z = s.where("tokens > 0").agg(F.sum(F.pow("r", a)).alias("z"))
    s = s.crossJoin(F.broadcast(z)).withColumn("weight", F.when(F.col("tokens") > 0, F.pow("r", a) / F.col("z")).otherwise(0.0))
    if budget is None:
        wanted = F.round(F.col("most") * F.pow("r", a)).cast("long")
    else:
        wanted = F.round(F.lit(float(budget)) * F.col("weight")).cast("long")
    s = s.withColumn("budget", F.when(F.col("tokens") > 0, wanted).otherwise(F.lit(0).cast("long")))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    s = s.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("epochs") * F.col("tokens")))
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)))).cast("long")
    return s.withColumn("blocks", blocks).select("source", "tokens", "docs", "weight", "budget", "epochs", "rest", "blocks")


def _hex_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget: int | None = None, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each time that a document is shown: source, epoch, block (its place in
    the epoch), position (in the block), id, n_tokens."""
    if target_entropy is not None:
        max_repetition = None
    light = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens"),
        ),
        "mix",
    )
    sources = written(shares(light, "source", F.col("n_tokens")), "shares")
    exponent = bisect_exponent(sources, target_entropy, max_repetition)
    w = written(weights(sources, exponent, budget), "weights")
    # Each document once for every epoch in which it may be shown.
    shown = light.join(w.select("source", "epochs", "rest", "blocks"), "source").select(
        "source",
        "id",
        "n_tokens",
        "blocks",
        "epochs",
        "rest",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - F.when(F.col("rest") > 0, 0).otherwise(1))).alias("epoch"),
    ).where("epoch < epochs OR rest > 0")
    mark = F.concat_ws("\x1f", F.lit(seed), "source", F.col("epoch").cast("string"), F.col("id").cast("string"))
    shown = shown.withColumn("slot", _hex_number(mark) % F.col("blocks")).withColumn("mark", F.md5(F.concat(mark, F.lit("\x1fplace")).cast("binary")))
    block_mark = F.md5(F.concat_ws("\x1f", F.lit(seed), "source", F.col("epoch").cast("string"), F.col("slot").cast("string")).cast("binary"))
    totals = shown.groupBy("source", "epoch", "slot").agg(F.sum("n_tokens").alias("block_tokens"))
    # At most MAX_BLOCKS rows for each source and epoch.
    by_epoch = Window.partitionBy("source", "epoch").orderBy("block_mark", "slot")
    order = totals.withColumn("block_mark", block_mark).select(
        "source",
        "epoch",
        "slot",
        (F.row_number().over(by_epoch) - 1).cast("long").alias("block"),
        (F.sum("block_tokens").over(by_epoch) - F.col("block_tokens")).alias("before"),
    )
    in_block = Window.partitionBy("source", "epoch", "slot").orderBy("mark", "id")
    placed = shown.join(order, ["source", "epoch", "slot"]).select(
        "source",
        "epoch",
        "block",
        (F.row_number().over(in_block) - 1).cast("long").alias("position"),
        "id",
        "n_tokens",
        (F.col("before") + F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0))).alias("so_far"),
        "epochs",
        "rest",
    )
    return placed.where("epoch < epochs OR so_far <= rest").select(
        "source", "epoch", "block", "position", F.col("id").alias(id_col), "n_tokens"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", places: bool = False, **how) -> DataFrame:
    """The mixed table: all columns of ``docs``, each row as often as the plan shows it. ``places`` adds
    mix_epoch, mix_block and mix_position, the order in which to show them.

    Rows are stored with a name of their own, by which the plan draws: the id, and the row's
    number where several rows have that id or it is null."""
    name, n = fresh(docs, "_name"), fresh(docs, "_rows")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    shared = F.col(id_col).isNull() | F.col(n).isNotNull()
    own = F.when(shared, F.concat_ws("#", F.col(id_col).cast("string"), F.lit(""), F.monotonically_increasing_id().cast("string"))).otherwise(F.col(id_col).cast("string"))
    rows = written(few_joined(docs, written(twice, "twice"), id_col, how="left").withColumn(name, own).select(*docs.columns, name), "rows")
    shown = plan(rows, id_col=name, **how).select(name, *[F.col(c).alias(f"mix_{c}") for c in ("epoch", "block", "position")])
    mixed = few_joined(rows, written(shown, "shown"), name).drop(name)
    return mixed if places else mixed.select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source
), r AS (
  SELECT source, tokens, tokens / (SELECT max(tokens) FROM s)::DOUBLE AS r FROM s WHERE tokens > 0
), b(low, high) AS (
  SELECT 0, 1048576
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS mid,
               (SELECT max(pow(r, ((low + high) // 2) / 1048576.0::DOUBLE - 1)) FROM r) <= 2.0 AS ok
        FROM b WHERE high - low > 1)
), x AS (
  SELECT CASE WHEN (SELECT max(pow(r, -1.0::DOUBLE)) FROM r) <= 2.0 THEN 0.0::DOUBLE
              ELSE (SELECT min(high) FROM b) / 1048576.0::DOUBLE END AS a
), w AS (
  SELECT s.source, s.tokens,
         CASE WHEN s.tokens > 0 THEN CAST(round((SELECT max(tokens) FROM s)::DOUBLE * pow(r.r, (SELECT a FROM x))) AS BIGINT) ELSE 0 END AS budget
  FROM s LEFT JOIN r ON s.source = r.source
), e AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
         CAST(least(4096, greatest(1, ceil(tokens / 65536.0))) AS BIGINT) AS blocks
  FROM w
), shown AS (
  SELECT d.source, doc_id, n_tokens, blocks, epochs, rest, unnest(range(0, epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch
  FROM d JOIN e ON d.source = e.source
), m AS (
  SELECT *, 'mix-1' || chr(31) || source || chr(31) || epoch || chr(31) || doc_id AS mark FROM shown
), k AS (
  SELECT *, CAST('0x' || md5(mark)[1:8] AS BIGINT) % blocks AS slot, md5(mark || chr(31) || 'place') AS place FROM m
), t AS (
  SELECT source, epoch, slot, sum(n_tokens) AS block_tokens,
         md5('mix-1' || chr(31) || source || chr(31) || epoch || chr(31) || slot) AS block_mark
  FROM k GROUP BY source, epoch, slot
), o AS (
  SELECT source, epoch, slot, row_number() OVER v - 1 AS block, sum(block_tokens) OVER v - block_tokens AS before
  FROM t WINDOW v AS (PARTITION BY source, epoch ORDER BY block_mark, slot)
), p AS (
  SELECT k.source, k.epoch, o.block, row_number() OVER i - 1 AS position, doc_id, n_tokens, epochs, rest,
         before + sum(n_tokens) OVER (PARTITION BY k.source, k.epoch, k.slot ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS so_far
  FROM k JOIN o ON k.source = o.source AND k.epoch = o.epoch AND k.slot = o.slot
  WINDOW i AS (PARTITION BY k.source, k.epoch, k.slot ORDER BY place, doc_id)
)
SELECT source, epoch, block, position, doc_id, n_tokens FROM p WHERE epoch < epochs OR so_far <= rest
"""
