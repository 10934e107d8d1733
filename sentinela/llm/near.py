"""What both near-duplicate operators share: word hashes, MinHash, bands, links.

``link`` finds the connected classes of similar nodes without emitting all pairs
of a bucket. Every bucket has a hub, its most central node, and each member is
compared with it: n members, n - 1 comparisons. What the hub is not linked with,
directly or through others, is a stray. While that pays, the most central stray is
made a hub as well. The rest is settled exactly by differences (``_by_difference``):
a stray and any member that reach the threshold must share more than half of what
sets the member apart from the hub, so only members that share a rare part of their
difference are compared. No link that a bucket holds is lost and nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela.functions.ship import ship
from sentinela.llm.common import components, drop_written, few_joined, written

#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PART = 64  # texts compared at a time
PART_CHARS = 200_000  # of the texts hashed at a time, so that their shingles stay in the CPU's cache
#: Members of a hub that are compared in one run of rows; a larger group has several.
RUN = 512
#: A further hub in each bucket pays while this share of its comparisons are links.
YIELD = 0.1


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes.split() splits at exactly the contracts' white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def word_ids(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; hashing anew is faster than a large dictionary."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of all words if there are fewer."""
    if len(ids) == 0:
        return ids
    width = min(width, len(ids))
    n = len(ids) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = mixed(h + ids[j : j + n] + np.uint64(j + 1))
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_ids(words(text)), width))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after the other, and how many each has."""
    ids = [word_ids(words(t)) for t in texts]
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    if len(flat) < width:
        h, keep = np.zeros(0, np.uint64), np.zeros(0, bool)
    else:
        h, keep = shingles(flat, width), np.ones(len(flat) - width + 1, bool)
    for k in range(1, width):  # runs that go on into the next text
        over = ends - k
        keep[over[(over >= ends - n) & (over < len(keep))]] = False
    size = np.maximum(n - width + 1, 0)
    h = h[keep]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):  # all words are one shingle
        own = np.split(h, np.cumsum(size)[:-1])
        for i in few:
            own[i] = shingles(ids[i], width)
        size = np.array([len(x) for x in own], np.int64)
        h = np.concatenate(own)
    text = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, text))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(size))


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows, so many at a time that their texts have about ``PART_CHARS``."""
    for batch in batches:
        start, size = 0, 0
        for k, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()):
            size += n
            if size >= PART_CHARS:
                yield batch.slice(start, k + 1 - start)
                start, size = k + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of ``count`` permutations of 32-bit numbers."""
    rng = np.random.Generator(np.random.PCG64(20240501))
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def tune(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` values that find a pair at the threshold with this recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def pass_mark(n: int, threshold: float, miss: float) -> int:
    """Least number of agreeing values among n that a pair needs to go on.

    Under a uniform prior the posterior after m of n agree is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m). Below ``miss`` the pair is pruned.
    """
    total, m = 0.0, 0
    for k in range(n + 2):
        total += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        if total >= miss:
            m = k
            break
    return m


def signatures(rows: DataFrame, id_col: str, text_col: str, width: int, values: int, also: Sequence[str] = (), bits: int = 16) -> DataFrame:
    """(id, th, n, digest, sig, and the columns ``also``) of each row; th: hash of its text; digest and
    sig are null for an empty set. A signature value is the top 16 bits of a 32-bit minimum, or all 32.
    Minima of n parts are about n times likelier to be equal by chance than their bits tell, so bands of
    few values need all."""
    ship(rows.sparkSession)
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = permutations(values)
        for part in _parts(batches, 2):
            flat, size = shingle_sets([t.as_py() for t in part.column(2)], width)
            some = np.flatnonzero(size)
            sig = np.zeros((len(some), values), f"u{bits // 8}")
            cut = np.cumsum(size[some]) - size[some]
            if len(some):
                short = (flat >> np.uint64(32)).astype(np.uint32)
                buf = np.empty_like(short)
                for k in range(values):
                    np.multiply(short, mult[k], out=buf)
                    np.add(buf, add[k], out=buf)
                    sig[:, k] = np.minimum.reduceat(buf, cut) >> np.uint32(32 - bits)
            sigs, digests, raw = [None] * len(size), [None] * len(size), flat.tobytes()
            for j, (i, at) in enumerate(zip(some.tolist(), cut.tolist(), strict=True)):
                sigs[i] = sig[j].tobytes()
                digests[i] = hashlib.blake2b(raw[8 * at : 8 * (at + int(size[i]))], digest_size=16).digest()
            cols = [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *part.columns[3:]], names=["id", "th", "n", "digest", "sig", *also])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(["id bigint, th bigint, n bigint, digest binary, sig binary", *(f"`{c}` {types[c]}" for c in also)]))


def band_keys(sig: Column, rows: int, bands: int, bits: int = 16) -> Column:
    """The band keys of a signature of values of ``bits``."""
    size = bits // 8 * rows
    return F.array(*[F.xxhash64(F.lit(b), F.substring(sig, 1 + size * b, size)) for b in range(bands)])


class Linker:
    """Compares nodes. ``nodes``: (node, n, sig, and the columns ``at`` that find its text);
    ``texts``: (columns ``at``, text)."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, at: list[str], width: int, threshold: tuple[int, int], batch: int, miss: float, bits: int = 16):
        self.nodes, self.texts, self.at = nodes, texts, at
        self.width, self.threshold, self.batch, self.miss, self.bits = width, threshold, batch, miss, bits
        self.made: list[DataFrame] = []

    def load(self, used: DataFrame) -> DataFrame:
        """Store size, signature and text of the nodes that share a bucket with another."""
        own = few_joined(self.nodes, used, "node").dropDuplicates(["node"])
        texts = few_joined(self.texts, own.drop("n", "sig"), *self.at).dropDuplicates(["node"]).select("node", "text")
        self.own = written(texts.join(own.select("node", "n", "sig"), "node"), "compared")
        return self.own

    def _runs(self, pairs: DataFrame, *cols: str) -> DataFrame:
        """The pairs (hub, node, ...) as sorted runs: a hub's row, then up to about RUN of its
        members. Each pair moves one text, whatever the size of the hub's group."""
        # Few hubs have more members than a run takes; the others have one run.
        large = written(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > RUN), "large")
        dealt = few_joined(pairs, large, "hub", how="left").withColumn("run", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / RUN)), F.lit(0)).cast("int")).drop("k")
        dealt = written(dealt, "dealt")
        self.made += [large, dealt]
        members = dealt.join(self.own, "node").select("hub", "run", F.lit(1).alias("member"), "node", "n", "sig", "text", *cols)
        heads = dealt.select("hub", "run").distinct().join(self.own.withColumnRenamed("node", "hub"), "hub")
        heads = heads.select("hub", "run", F.lit(0).alias("member"), F.col("hub").alias("node"), "n", "sig", "text", *[F.lit(None).cast(dict(dealt.dtypes)[c]).alias(c) for c in cols])
        return heads.union(members).repartition("hub", "run").sortWithinPartitions("hub", "run", "member")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (hub, node) that reach the threshold: sizes first, then the
        signatures batch by batch, then the full sets."""
        num, den = self.threshold
        width, batch, level, miss, kind = self.width, self.batch, num / den, self.miss, f"u{self.bits // 8}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks: list[tuple[int, int, int]] = []
            n_hub, sig_hub, text_hub, set_hub = 0, np.zeros(0, kind), "", None
            for rb in batches:
                a, b = [], []
                hubs, member, nodes, sizes = (rb.column(k).to_pylist() for k in (0, 2, 3, 4))
                for k in range(rb.num_rows):
                    sig = np.frombuffer(rb.column(5)[k].as_py(), kind)
                    if not member[k]:
                        n_hub, sig_hub, text_hub, set_hub = sizes[k], sig, rb.column(6)[k], None
                        marks = marks or [(at, at + batch, pass_mark(min(at + batch, len(sig)), level, miss)) for at in range(0, len(sig), batch)]
                        continue
                    if den * min(sizes[k], n_hub) < num * max(sizes[k], n_hub):
                        continue
                    agree, same = 0, sig == sig_hub
                    for low, high, mark in marks:
                        agree += int(np.count_nonzero(same[low:high]))
                        if agree < mark:
                            break
                    else:
                        if set_hub is None:
                            set_hub = shingle_set(text_hub.as_py(), width)
                        x = shingle_set(rb.column(6)[k].as_py(), width)
                        both = len(np.intersect1d(set_hub, x, assume_unique=True))
                        if den * both >= num * (len(x) + len(set_hub) - both):
                            a.append(min(hubs[k], nodes[k]))
                            b.append(max(hubs[k], nodes[k]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return self._runs(pairs).mapInArrow(run, "a bigint, b bigint")

    def differences(self, pairs: DataFrame) -> DataFrame:
        """(hub, node, n, c, far, parts, half, full): what only one of hub and member has, and how
        many of its rarest parts a partner must touch (see ``_by_difference``)."""
        num, den = self.threshold
        width, less, all_ = self.width, den - num, den + num

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub = np.zeros(0, np.uint64)
            for rb in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
                member, parts, half, full, keep = rb.column(2).to_pylist(), [], [], [], []
                for k in range(rb.num_rows):
                    x = shingle_set(rb.column(6)[k].as_py(), width)
                    if not member[k]:
                        hub = x
                        continue
                    d = np.setxor1d(x, hub, assume_unique=True)
                    least = (all_ * len(d) + less * (len(hub) - len(x))) // (2 * all_) + 1
                    far = max(1, -((less * (len(hub) + len(x)) - all_ * len(d)) // (2 * all_)))
                    keep.append(k)
                    parts.append(d.view(np.int64))
                    half.append(max(0, len(d) - least + 1))
                    full.append(max(0, len(d) - far + 1))
                some = rb.take(pa.array(keep, pa.int64()))
                cols = [some.column(0), some.column(3), some.column(4), some.column(7), some.column(8), pa.array(parts, pa.list_(pa.int64())), pa.array(half, pa.int32()), pa.array(full, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["hub", "node", "n", "c", "far", "parts", "half", "full"])

        return self._runs(pairs, "c", "far").mapInArrow(run, "hub bigint, node bigint, n bigint, c bigint, far boolean, parts array<bigint>, half int, full int")


def _by_difference(linker: Linker, open_: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Pairs (hub, node) of members of open buckets that may still be similar.

    ``open_``: (hub, node, c, far), c the class so far, far if it isn't the hub's. Let
    d(x) be the symmetric difference of member and hub. Similarity t of x and y means
    |x ^ y| <= (|x| + |y|)(1-t)/(1+t), and |x ^ y| = |d(x)| + |d(y)| - 2 |d(x) & d(y)|. As x is
    far, |d(x)| > (|x| + |hub|)(1-t)/(1+t). Both together: x and y share more than
    (|d(y)| + (|hub| - |y|)(1-t)/(1+t)) / 2 parts, so, in any one order of the parts, one
    of the first ``half`` of d(y) and of the first ``full`` of d(x). The order is by rarity.
    What follows the first part that they share bounds how many they can share.
    """
    num, den = linker.threshold
    made.append(diff := written(linker.differences(open_), "differences"))
    each = diff.select("hub", "node", F.explode("parts").alias("part"))
    rare = each.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("f"))
    ordered = each.join(rare, ["hub", "part"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("f", "part"))).alias("o"))  # bounded by two texts
    spots = diff.withColumn("size", F.size("parts")).drop("parts").join(ordered, ["hub", "node"]).select("hub", "node", "n", "c", "far", "half", "full", "size", F.posexplode("o").alias("at", "o"))
    spots = spots.where("o.f > 1 AND at < IF(far, greatest(half, full), half)")
    made.append(spots := written(spots.select("hub", "node", "n", "c", "far", "size", (F.col("size") - F.col("at")).alias("rest"), F.col("o.part").alias("part"), (F.col("at") < F.col("half")).alias("early")), "parts"))
    names = ["node", "n", "c", "far", "size", "rest", "early"]
    side = lambda df, name: df.select("hub", "part", *[F.col(c).alias(f"{c}_{name}") for c in names])
    twice = F.expr(f"{den + num} * (size_x + size_y) - {den - num} * (n_x + n_y)")  # of what they must share
    return side(spots.where("far"), "x").join(side(spots.where("early"), "y"), ["hub", "part"]).where(
        F.expr("node_x <> node_y AND c_x <> c_y AND (NOT far_y OR NOT early_x OR node_x < node_y)") & (2 * (den + num) * F.least("rest_x", "rest_y") >= twice)
    ).select(F.least("node_x", "node_y").alias("hub"), F.greatest("node_x", "node_y").alias("node")).distinct()


def link(keyed: DataFrame, linker: Linker) -> DataFrame | None:
    """(node, component) of the nodes with a link; None if there is none.

    ``keyed``: (key, node), the band keys of every node, repeated or not. Files on the way are deleted.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        made.append(written(df, tag))
        return made[-1]

    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    buckets = kept(few_joined(keyed, kept(shared, "shared"), "key").select("key", "node").distinct(), "buckets")
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    central = buckets.join(sizes, "key").groupBy("node").agg(F.sum("k").alias("weight"))
    made.append(linker.load(central.select("node")))
    rows = kept(buckets.select("key", "node").join(central, "node"), "weighed")
    comp, edges, tried, settled = None, [], [], 0

    def classed(df: DataFrame, name: str) -> DataFrame:
        """``df`` with the class so far of its column ``name``."""
        if comp is None:
            return df.withColumn(f"c_{name}", F.col(name))
        found = comp.select(F.col("node").alias(name), F.col("component").alias("_c"))
        return df.join(found, name, "left").withColumn(f"c_{name}", F.coalesce("_c", name)).drop("_c")

    def mixed_only(df: DataFrame) -> DataFrame:
        """Rows of the buckets that hold two classes."""
        still = df.groupBy("key").agg(F.min("c_node").alias("lo"), F.max("c_node").alias("hi")).where("lo <> hi").select("key")
        return df.join(still, "key", "left_semi")

    def compare(pairs: DataFrame) -> tuple[int, int]:
        pairs = kept(pairs, "pairs")
        found = kept(linker.similar(pairs), "links")
        tries, links = pairs.count(), found.count()
        if links:
            edges.append(found)
        return tries, links

    def settle() -> DataFrame | None:
        return written(components(reduce(DataFrame.union, edges)), "classes") if edges else None

    while True:
        now = kept(mixed_only(classed(rows, "node")), "open") if tried else classed(rows, "node")
        strays = now
        for was in tried:  # classes that have had a hub in the bucket need no other
            strays = strays.join(classed(was, "hub").select("key", F.col("c_hub").alias("c_node")), ["key", "c_node"], "left_anti")
        best = F.min(F.struct((-F.col("weight")).alias("w"), "node", "c_node")).alias("h")
        hubs = kept(strays.groupBy("key").agg(best).select("key", F.col("h.node").alias("hub"), F.col("h.c_node").alias("c_hub")), "hubs")
        tries, links = compare(now.join(hubs, "key").where("node <> hub AND c_node <> c_hub").select("hub", "node").distinct())
        tried.append(hubs.select("key", "hub"))
        if len(tried) == 1 or links >= YIELD * tries > 0:  # else the few links wait for the end
            comp, settled = settle(), len(edges)
        if links < YIELD * tries or not links:
            break
        rows = now.select("key", "node", "weight")
    # What is left open is compared by differences from the bucket's first hub.
    left = mixed_only(classed(classed(now.select("key", "node").join(tried[0], "key"), "node"), "hub")).where("node <> hub")
    left = kept(left.select("hub", "node", F.col("c_node").alias("c"), (F.col("c_node") != F.col("c_hub")).alias("far")).distinct(), "open")
    compare(_by_difference(linker, left, made))
    if len(edges) > settled:
        comp = settle()
    for df in [*made, *linker.made]:
        drop_written(df)
    return comp
