"""Language-model scoring by context-tree weighting.

A text is its lower-cased words joined by single spaces and closed by an end
symbol (byte 0xFF, which UTF-8 never uses; it also fills the context before the
first byte). Each byte is eight binary decisions; the decisions made after the
same leading bits form one context tree over the last ``DEPTH`` bytes. Each node
holds the Krichevsky-Trofimov estimate of its counts, and a decision's
probability mixes the estimates of all depths with the posterior weight that
the tree ends at each node:

    p(s) = w(s) * kt(s) + (1 - w(s)) * p(longer context),  w(s) = kt_block(s) / 2 / weighted(s)

A context that training hasn't seen adds no evidence and the mix ends above it.
The batch form is exact because KT block probabilities depend on counts alone.

The corpus is read once. Each scan task packs its texts into compressed blocks and
counts each block's distinct byte windows and words; all of this is written to
the shared folder. Windows are dealt to shards by the last two bytes of their
context, so everything below depth 2 of a tree lies in one shard, which merges
its counts in a stream; the two depths above are a table of at most 65,280 rows.
Shards answer each block with the code length of its windows, and each block
adds them up along its texts. Memory is bounded by one block and by the distinct
windows of one shard; ``shards`` grows with the corpus.

Defined results: null and empty texts are just the end symbol; repeated rows are
learned from and scored each; a null id is learned from and not held out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.ship import ship
from sentinela.llm.common import documents, written
from sentinela.llm.near import LOWER

DEPTH = 5
END = 255
BLOCK_BYTES = 6_000_000
SHARDS = 64
SHARD_BYTES = 2_000_000_000  # of input for each shard, where that makes more than SHARDS
FOLDS, HELD = 7, 2
_GRAM_BITS = 8 * (DEPTH + 1)
_MASK = np.uint64((1 << _GRAM_BITS) - 1)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The window (context bytes, then the byte itself as the lowest) of every byte and
    end symbol of the texts, and the number of windows of each text."""
    pad = bytes([END]) * DEPTH
    raw = b"".join(pad + t + b"\xff" for t in texts)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    wide = np.frombuffer(b"\0" * 2 + raw + b"\0" * 8, np.uint8)
    at = np.ndarray((len(raw) - DEPTH,), ">u8", wide.data, strides=(1,))  # bytes i-2 .. i+5
    codes = at.astype(np.uint64) & _MASK
    starts = np.cumsum(size + DEPTH) - size - DEPTH
    place = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return codes[place], size


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes of the context."""
    two = (codes >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)


def counted(values: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and their number or summed weight."""
    order = np.argsort(values) if weight is not None else None
    values = values[order] if weight is not None else np.sort(values)
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    if weight is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weight[order], first)


def _loggamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5, by Stirling's series after a shift by 8."""
    y = x + 8.0
    inv = 1.0 / y
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series
    prod = x.copy()
    for k in range(1, 8):
        prod *= x + k
    return out - np.log(prod)


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of any sequence with a zeros and b ones."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return _loggamma(a + 0.5) + _loggamma(b + 0.5) - _loggamma(a + b + 1.0) - np.log(np.pi)


def packed_ints(x: np.ndarray) -> bytes:
    """Sorted or small integers, compressed: differences by byte planes."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_ints(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1))


def packed_words(ws: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(ws))


def unpacked_words(raw: bytes) -> list[bytes]:
    joined = zstandard.ZstdDecompressor().decompress(raw)
    return joined.split(b"\n") if joined else []


class Depth:
    """The distinct windows of one depth, sorted, so that at each bit place the windows of
    one node (context and leading bits) stand together."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        part = codes & np.uint64((1 << (8 * (depth + 1))) - 1)
        if len(part) and (part[1:] >= part[:-1]).all():
            first = np.append(True, part[1:] != part[:-1])[: len(part)]
            self.codes, self.up = part[first], np.cumsum(first) - 1
        else:
            self.codes, self.up = np.unique(part, return_inverse=True)
        self.n = np.bincount(self.up, n, len(self.codes))


class Level:
    """The nodes of one depth at one bit place."""

    def __init__(self, d: Depth, bit: int):
        key = d.codes >> np.uint64(8 - bit)
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        self.first = np.flatnonzero(new)
        self.row = np.cumsum(new) - 1
        self.node = key[self.first]
        self.one = ((d.codes >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        total = np.add.reduceat(d.n, self.first) if len(key) else np.zeros(0)
        self.b = np.add.reduceat(np.where(self.one, d.n, 0), self.first) if len(key) else np.zeros(0)
        self.a = total - self.b


def weigh(codes: np.ndarray, n: np.ndarray, low: int) -> Iterator[tuple[int, list[Depth], list[Level], list[np.ndarray], list[np.ndarray]]]:
    """For each bit: depths and levels from DEPTH up to ``low``, ln weighted, ln block probability."""
    depths: list[Depth] = []
    for depth in range(DEPTH, low - 1, -1):
        above = depths[-1] if depths else None
        depths.append(Depth(above.codes if above else codes, above.n if above else n, depth))
    for bit in range(8):
        ls, ws, ks = [], [], []
        for k, d in enumerate(depths):
            lv = Level(d, bit)
            kt = kt_block(lv.a, lv.b)
            if k == 0:
                w = kt
            else:
                # Each longer context hangs on the context without its first byte.
                parent = lv.row[d.up[ls[-1].first]]
                w = np.logaddexp(kt, np.bincount(parent, ws[-1], len(lv.node))) - np.log(2.0)
            ls.append(lv)
            ws.append(w)
            ks.append(kt)
        yield bit, depths, ls, ws, ks


def top_rows(codes: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(bit, depth-1 node, a, b, sum of ln weighted of its depth-2 nodes) of one shard."""
    out = []
    for bit, _, levels, weighted, _ in weigh(codes, n, 2):
        lv, w = levels[-1], weighted[-1]
        one = lv.node & np.uint64((1 << (8 + bit)) - 1)
        node, row = np.unique(one, return_inverse=True)
        cols = (node, np.bincount(row, lv.a), np.bincount(row, lv.b), np.bincount(row, w))
        out += [(bit, int(x), float(a), float(b), float(s)) for x, a, b, s in zip(*cols, strict=True)]
    return out


def top_tables(rows: list[tuple[int, int, float, float, float]]) -> list[dict[str, np.ndarray]]:
    """Of depths 1 and 0 for each bit: nodes, estimates' counts and end weights."""
    out = []
    for bit in range(8):
        mine = sorted(r[1:] for r in rows if r[0] == bit)
        node, a, b, s = (np.array(c) for c in zip(*mine, strict=True)) if mine else (np.zeros(0),) * 4
        node = node.astype(np.uint64)
        kt1 = kt_block(a, b)
        w1 = np.logaddexp(kt1, s) - np.log(2.0)
        zero = node & np.uint64((1 << bit) - 1) if bit else np.zeros(len(node), np.uint64)
        node0, row0 = np.unique(zero, return_inverse=True)
        a0, b0 = np.bincount(row0, a, len(node0)), np.bincount(row0, b, len(node0))
        kt0 = kt_block(a0, b0)
        w0 = np.logaddexp(kt0, np.bincount(row0, w1, len(node0))) - np.log(2.0)
        out.append({"node1": node, "a1": a, "b1": b, "end1": np.exp(kt1 - np.log(2.0) - w1), "node0": node0, "a0": a0, "b0": b0, "end0": np.exp(kt0 - np.log(2.0) - w0)})
    return out


def code_lengths(codes: np.ndarray, n: np.ndarray, top: list[dict[str, np.ndarray]]) -> np.ndarray:
    """log10 probability of each window's last byte in its context; windows that
    only held-out texts have come with n = 0."""
    total = np.zeros(len(codes))
    for bit, depths, levels, weighted, block in weigh(codes, n, 2):
        p, below_seen, at_ = np.full(len(codes), 0.5), np.zeros(len(codes), bool), np.arange(len(codes))
        for k, (d, lv, w, kt) in enumerate(zip(depths, levels, weighted, block, strict=True)):
            at_ = d.up[at_]  # each window's entry at this depth
            all_ = lv.a + lv.b
            q = (np.where(lv.one, lv.b[lv.row], lv.a[lv.row]) + 0.5) / (all_[lv.row] + 1.0)
            end = np.ones(len(w)) if k == 0 else np.exp(kt - np.log(2.0) - w)
            q, e, seen = q[at_], end[lv.row][at_], (all_ > 0)[lv.row][at_]
            p = np.where(seen, np.where(below_seen, e * q + (1.0 - e) * p, q), p)
            below_seen = seen
        one = ((codes >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        for depth, name in ((1, "1"), (0, "0")):
            t = top[bit]
            key = (codes & np.uint64((1 << (8 * (depth + 1))) - 1)) >> np.uint64(8 - bit)
            at = np.minimum(np.searchsorted(t["node" + name], key), max(0, len(t["node" + name]) - 1))
            ok = t["node" + name][at] == key if len(t["node" + name]) else np.zeros(len(key), bool)
            if not ok.any():
                continue
            a, b, end = t["a" + name][at], t["b" + name][at], t["end" + name][at]
            known = ok & (a + b > 0)
            q = np.where(one, b + 0.5, a + 0.5) / (a + b + 1.0)
            p = np.where(known, np.where(below_seen, end * q + (1.0 - end) * p, q), p)
            below_seen = known | below_seen
        total += np.log10(p)
    return total


_PACK = "kind string, shard int, block bigint, keys binary, n binary"


def _pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, shards: int) -> DataFrame:
    """Blocks: their texts (kind text), windows (gram) and words (word) by shard."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def block_rows(block: int, ids: list, texts: list[str | None]) -> Iterator[tuple]:
        toks = [tokens_of(t) for t in texts]
        train = np.array([not held_out(i) for i in ids], bool)
        body = [b" ".join(t) for t in toks]
        yield ("text", 0, block, zstandard.ZstdCompressor(level=1).compress(pickle.dumps((ids, body))), b"")
        codes, size = grams(body)
        learn = np.repeat(train, size)
        marked, times = counted(codes << np.uint64(1) | learn.astype(np.uint64))  # one sort for both counts
        every, n = counted(marked >> np.uint64(1), times * (marked & np.uint64(1)).astype(np.int64))
        dealt = shard_of(every, shards)
        for s in np.unique(dealt):
            m = dealt == s
            yield ("gram", int(s), block, packed_ints(every[m]), packed_ints(n[m]))
        flat = pa.array([w for t in toks for w in t], pa.binary()).dictionary_encode()
        per = np.array([len(t) for t in toks], np.int64)
        index = flat.indices.to_numpy(zero_copy_only=False)
        vocabulary = flat.dictionary.to_pylist()
        count = np.bincount(index[np.repeat(train, per)], minlength=len(vocabulary)) if len(index) else np.zeros(0, np.int64)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(vocabulary):
            by.setdefault(xxhash.xxh3_64_intdigest(w) % shards, []).append(k)
        for s, ks in by.items():
            ks.sort(key=vocabulary.__getitem__)
            yield ("word", s, block, packed_words([vocabulary[k] for k in ks]), packed_ints(count[ks]))
        yield ("total", 0, block, b"", np.array([count.sum() + train.sum(), train.sum()], np.int64).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, seq, part = [], [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in block_rows((part << 32) + seq, ids, texts):
                yield pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for i, t, p in zip(*batch.columns, strict=True):
                part = p.as_py()
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "") + 1
                if size >= block_bytes:
                    yield from flush()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield from flush()

    return src.mapInArrow(run, _PACK)


_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(c[k].as_py() for c in b.columns)


def _merge_grams(so_far: tuple[np.ndarray, np.ndarray], rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([so_far[0], *(unpacked_ints(k).view(np.uint64) for k, _ in rows)])
    n = np.concatenate([so_far[1], *(unpacked_ints(c) for _, c in rows)])
    return counted(keys, n)


def _merged(packed: DataFrame) -> DataFrame:
    """(kind, shard, keys, n, top): the counts of each shard over all blocks."""

    def finish(kind, shard, state):
        if kind == "gram":
            codes, n = state
            return (kind, shard, packed_ints(codes), packed_ints(n), pickle.dumps(top_rows(codes[n > 0], n[n > 0])))
        ws = sorted(state)
        return (kind, shard, packed_words(ws), packed_ints(np.array([state[w] for w in ws], np.int64)), pickle.dumps(sum(1 for w in ws if state[w])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        state: Any = None
        waiting: list[tuple[bytes, bytes]] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal state, waiting
            if now is None:
                return
            if now[0] == "gram" and waiting:
                state = _merge_grams(state, waiting)
            row = finish(*now, state)
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int32())] + [pa.array([x], pa.binary()) for x in row[2:]], names=["kind", "shard", "keys", "n", "top"])

        for kind, shard, keys, n in _rows(batches):
            if now != (kind, shard):
                yield from out()
                now, waiting = (kind, shard), []
                state = {} if kind == "word" else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if kind == "gram":
                waiting.append((keys, n))
                if len(waiting) >= 64:  # fold, so that memory follows the distinct windows only
                    state, waiting = _merge_grams(state, waiting), []
            else:
                for w, c in zip(unpacked_words(keys), unpacked_ints(n).tolist(), strict=True):
                    state[w] = state.get(w, 0) + c
        yield from out()

    rows = packed.where("kind IN ('gram', 'word')").select("kind", "shard", "keys", "n")
    dealt = rows.repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    return dealt.mapInArrow(run, "kind string, shard int, keys binary, n binary, top binary")


def _answers(packed: DataFrame, model: DataFrame, top: list[dict[str, np.ndarray]]) -> DataFrame:
    """(block, kind, shard, values): for each key that a block asked for, in its order."""
    asked = packed.where("kind IN ('gram', 'word')").select("kind", "shard", "block", "keys", F.lit(None).cast("binary").alias("n"))
    known = model.select("kind", "shard", F.lit(-1).cast("long").alias("block"), "keys", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = values = None
        table: dict[bytes, int] = {}
        for kind, shard, block, keys, n in _rows(batches):
            if block < 0:
                n = unpacked_ints(n)
                if kind == "gram":
                    codes = unpacked_ints(keys).view(np.uint64)
                    values = code_lengths(codes, n, top)
                else:
                    table = dict(zip(unpacked_words(keys), n.tolist(), strict=True))
                continue
            if kind == "gram":
                got = values[np.searchsorted(codes, unpacked_ints(keys).view(np.uint64))].astype(np.float32).tobytes()
            else:
                got = packed_ints(np.array([table[w] for w in unpacked_words(keys)], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([kind]), pa.array([shard], pa.int32()), pa.array([keys if kind == "word" else b""], pa.binary()), pa.array([got], pa.binary())], names=["block", "kind", "shard", "keys", "values"])

    dealt = known.unionByName(asked).repartition("kind", "shard").sortWithinPartitions("kind", "shard", "block")
    return dealt.mapInArrow(run, "block bigint, kind string, shard int, keys binary, values binary")


def _totals(packed: DataFrame) -> tuple[int, int]:
    """Training tokens and training texts of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["t", "d"])

    per_block = packed.where("kind = 'total'").select("n").mapInArrow(run, "t bigint, d bigint")
    t, d = per_block.agg(F.sum("t"), F.sum("d")).first()
    return t or 0, d or 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10), bits_per_byte."""
    ship(docs.sparkSession)
    if shards is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        shards = min(65_536, max(SHARDS, size // SHARD_BYTES))
    packed = written(_pack(docs, id_col, text_col, block_bytes, shards), "blocks")
    model = written(_merged(packed), "model")
    n_train, n_docs = _totals(packed)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, cell in _rows(batches):
            got = pickle.loads(cell)
            rows = [(9, 0, float(got), 0.0, 0.0)] if kind == "word" else got
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["bit", "node", "a", "b", "s"])

    upper = (
        model.select("kind", "top").mapInArrow(tops, "bit int, node bigint, a double, b double, s double")
        .groupBy("bit", "node").agg(F.sum("a"), F.sum("b"), F.sum("s")).collect()  # at most 255 * 256 nodes and one row of words
    )
    vocabulary = int(sum(r[2] for r in upper if r[0] == 9)) + (1 if n_docs else 0)
    top = top_tables([tuple(r) for r in upper if r[0] < 8])
    answers = _answers(packed, model, top)
    denominator = n_train + vocabulary + 1

    def run(key, batches):
        ids, body, grams_, words_ = [], [], [], {}
        for kind, shard, keys, values in _rows(batches):
            if kind == "text":
                ids, body = pickle.loads(zstandard.ZstdDecompressor().decompress(keys))
            elif kind == "gram":
                grams_.append((shard, values))
            else:
                words_.update(zip(unpacked_words(keys), unpacked_ints(values).tolist(), strict=True))
        if not ids:
            return
        codes, size = grams(body)
        hashed = pa.array(codes).dictionary_encode()  # cheaper than looking each window up in sorted ones
        distinct = hashed.dictionary.to_numpy()
        order = np.argsort(distinct)
        dealt = shard_of(distinct[order], shards)
        value, in_order = np.zeros(len(order)), np.zeros(len(order))
        for shard, v in grams_:
            in_order[dealt == np.uint64(shard)] = np.frombuffer(v, np.float32)
        value[order] = in_order
        bits = value[hashed.indices.to_numpy()]
        cut = np.cumsum(size) - size
        total = np.add.reduceat(bits, cut)
        toks = [t.split(b" ") if t else [] for t in body]
        known, base, n_tok = [], [], []
        log = {}
        for t in toks:
            c = [words_[w] for w in t] + [n_docs]
            s = 0.0
            for x in c:
                if x not in log:
                    log[x] = np.log10((x + 1) / denominator)
                s += log[x]
            known.append(sum(1 for x in c if x))
            base.append(s)
            n_tok.append(len(c))
        out = [
            pa.array(ids, pa.int64()),
            pa.array([held_out(i) for i in ids]),
            pa.array(n_tok, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array([n_train] * len(ids), pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(total, pa.float64()),
            pa.array(-total / np.log10(2.0) / size, pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(out, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    texts = packed.where("kind = 'text'").select("block", "kind", "shard", "keys", F.lit(None).cast("binary").alias("values"))
    everything = texts.unionByName(answers.select("block", "kind", "shard", "keys", "values"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                cols = list(zip(*held, strict=True))
                yield from run(now, [pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["kind", "shard", "keys", "values"])])

        for block, *rest in _rows(batches):
            if block != now:
                yield from flush()
                now, held = block, []
            held.append(tuple(rest))
        yield from flush()

    return everything.repartition("block").sortWithinPartitions("block").mapInArrow(
        streamed, f"`{id_col}` bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    )


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
