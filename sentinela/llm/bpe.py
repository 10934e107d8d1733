"""Byte-level BPE with DuckDB recursive queries inside each partition.

Each Python worker holds one in-memory DuckDB with the merge table (left, right,
merged) and the vocabulary. A text is cut into words by the tokenizer's pattern.
Words that the worker hasn't met lately become token-position rows; a recursive
query joins neighbouring rows to the merge table and contracts each word's
leftmost minimum-rank pair until no pair is left. Decoding joins the ids to the
vocabulary and concatenates their bytes in an ordered aggregation.

No shuffle: encoding is one narrow stage. Memory is bounded by the Arrow batch,
``chunk_words`` rows of words in DuckDB and ``cache_words`` remembered words.
A word of more than ``LONG`` bytes (junk without a break) would need one round for each merge.
It is cut where no token has its two neighbouring bytes, which no merge can cross. What is
still long (a few letters over and over) goes to ``CONTRACT_LONG``, the same recursion with all
places of the least pair at once; where a contraction makes a lesser pair possible, only the
leftmost is taken, so the result is that of the one-by-one rule.

Defined results: null and empty texts have no tokens; special tokens are plain
text; repeated rows are encoded alike; an empty table gives an empty result;
other columns are not read; vocabulary paths are parameters and are read on the
executors.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.ship import ship
from sentinela.llm.common import documents

LONG = 512

CONTRACT = """
WITH RECURSIVE s(step, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM word_rows
  UNION ALL (
    WITH p AS (
      SELECT step, w, pos, tok,
             lead(tok) OVER by_word AS next_tok, lead(pos) OVER by_word AS next_pos
      FROM s WINDOW by_word AS (PARTITION BY w ORDER BY pos)
    ), best AS (
      SELECT p.w, min(CAST(m.merged AS BIGINT) * 4294967296 + p.pos) AS key,
             arg_min(p.next_pos, CAST(m.merged AS BIGINT) * 4294967296 + p.pos) AS gone
      FROM p JOIN merges m ON m.l = p.tok AND m.r = p.next_tok
      GROUP BY p.w
    )
    SELECT p.step + 1, p.w, p.pos,
           CASE WHEN p.pos = b.key % 4294967296 THEN CAST(b.key // 4294967296 AS INTEGER) ELSE p.tok END
    FROM p JOIN best b ON p.w = b.w
    WHERE p.pos <> b.gone
  )
), ended AS (SELECT w, max(step) AS step FROM s GROUP BY w)
SELECT s.w, s.tok FROM s JOIN ended USING (w, step) ORDER BY s.w, s.pos
"""

CONTRACT_LONG = """
WITH RECURSIVE s(step, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM word_rows
  UNION ALL (
    WITH p AS (
      SELECT step, w, pos, tok, lead(tok) OVER o AS t1, lead(tok, 2) OVER o AS t2, lag(tok) OVER o AS t0, row_number() OVER o AS rn
      FROM s WINDOW o AS (PARTITION BY w ORDER BY pos)
    ), k AS (
      SELECT p.*, m.merged AS made FROM p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.t1
    ), b AS (
      SELECT w, min(made) AS best FROM k GROUP BY w HAVING min(made) IS NOT NULL
    ), c AS (
      SELECT k.w, k.rn, b.best, least(x.merged, y.merged, z.merged) < b.best AS risk
      FROM k JOIN b ON k.w = b.w AND k.made = b.best
      LEFT JOIN merges x ON x.l = k.t0 AND x.r = b.best
      LEFT JOIN merges y ON y.l = b.best AND y.r = k.t2
      LEFT JOIN merges z ON z.l = b.best AND z.r = b.best
    ), g AS (
      SELECT *, rn - row_number() OVER (PARTITION BY w ORDER BY rn) AS island, bool_or(coalesce(risk, FALSE)) OVER (PARTITION BY w) AS risky, min(rn) OVER (PARTITION BY w) AS leftmost FROM c
    ), h AS (
      SELECT w, rn, best FROM (SELECT *, (rn - min(rn) OVER (PARTITION BY w, island)) % 2 AS odd FROM g) WHERE odd = 0 AND (NOT risky OR rn = leftmost)
    )
    SELECT k.step + 1, k.w, k.pos, coalesce(h.best, k.tok)
    FROM k JOIN b ON b.w = k.w LEFT JOIN h ON h.w = k.w AND h.rn = k.rn LEFT JOIN h gone ON gone.w = k.w AND gone.rn = k.rn - 1
    WHERE gone.w IS NULL
  )
), ended AS (SELECT w, max(step) AS step FROM s GROUP BY w)
SELECT s.w, s.tok FROM s JOIN ended USING (w, step) ORDER BY s.w, s.pos
"""

DECODE = """
SELECT t.row AS row, coalesce(sha256(unhex(string_agg(v.hex, '' ORDER BY t.pos))), sha256('')) AS sha
FROM token_rows t JOIN vocab v ON v.tok = t.tok GROUP BY t.row
"""
DECODE_BYTES = """
SELECT t.row AS row, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS raw
FROM token_rows t JOIN vocab v ON v.tok = t.tok GROUP BY t.row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _latin(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0250, where \\p{L} and \\p{N} are short classes."""
    import unicodedata

    def cls(first: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == first)

    letters, numbers = cls("L"), cls("N")
    for name, chars in (("L", letters), ("N", numbers)):
        pattern = re.sub(rf"(\[[^\]]*)\\p\{{{name}\}}", lambda m, c=chars: m[1] + c, pattern)
        pattern = pattern.replace(rf"\p{{{name}}}", f"[{chars}]")
    return re.compile(pattern)


class Coder:
    """One worker's vocabulary, word memory and DuckDB."""

    def __init__(self, path: str, pattern: str, cache_words: int = 400_000, chunk_words: int = 40_000):
        import duckdb

        self.ranks = read_ranks(path)
        self.full = regex.compile(pattern)
        self.latin = _latin(pattern)
        self.beyond = re.compile("[^\x00-\x1b\x20-ɏ]")  # U+001C..U+001F are white space to re only
        self.cache: dict[str, bytes] = {}
        self.cache_words, self.chunk_words = cache_words, chunk_words
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.beside = np.zeros(65536, bool)
        for token in self.ranks:
            for x, y in zip(token, token[1:], strict=False):
                self.beside[x * 256 + y] = True
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        ints = lambda x: pa.array(x, pa.int32())
        self._table("merges", {"l": ints(left), "r": ints(right), "merged": ints(merged)})
        hexes = pa.array([t.hex() for t in self.ranks])
        self._table("vocab", {"tok": ints(list(self.ranks.values())), "hex": hexes})

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("arrow_in", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_in")
        self.con.unregister("arrow_in")

    def _query(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()

    def words(self, text: str) -> list[str]:
        pattern = self.full if self.beyond.search(text) else self.latin
        return pattern.findall(text)

    def _contract(self, pieces: list[bytes], sql: str) -> list[bytes]:
        """Ids of each piece, contracted with a recursive query."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        pos = (np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        self._table("word_rows", {"w": w, "pos": pos, "tok": tok})
        got = self._query(sql)
        cut = (np.searchsorted(got.column("w").to_numpy(), np.arange(len(pieces) + 1)) * 4).tolist()
        flat = got.column("tok").to_numpy().astype("<u4").tobytes()
        return [flat[cut[k] : cut[k + 1]] for k in range(len(pieces))]

    def _apart(self, word: bytes) -> list[bytes]:
        """The word cut between bytes that stand side by side in no token."""
        b = np.frombuffer(word, np.uint8).astype(np.int32)
        at = [0, *(np.flatnonzero(~self.beside[b[:-1] * 256 + b[1:]]) + 1).tolist(), len(b)]
        return [word[x:y] for x, y in zip(at, at[1:], strict=False)]

    def _long(self, word: bytes) -> bytes:
        pieces = self._apart(word)
        out: dict[bytes, bytes] = {}
        short = [x for x in dict.fromkeys(pieces) if len(x) <= LONG]
        for k in range(0, len(short), self.chunk_words):
            out |= zip(short[k : k + self.chunk_words], self._contract(short[k : k + self.chunk_words], CONTRACT), strict=True)
        for x in dict.fromkeys(pieces):
            if x not in out:
                out[x] = self._contract([x], CONTRACT_LONG)[0]
        return b"".join(map(out.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        new = {w for words in cut for w in words if w not in self.cache}
        short = []
        for w in new:
            if len(w) * 4 > LONG and len(raw := w.encode()) > LONG:
                self.cache[w] = self._long(raw)
            else:
                short.append(w)
        for k in range(0, len(short), self.chunk_words):
            part = short[k : k + self.chunk_words]
            self.cache.update(zip(part, self._contract([w.encode() for w in part], CONTRACT), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _token_rows(self, ids: list[bytes]) -> None:
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        tok = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        self._table("token_rows", {"row": row, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok})

    def decoded_sha(self, ids: list[bytes]) -> list[str]:
        self._token_rows(ids)
        got = self._query(DECODE)
        found = dict(zip(got.column("row").to_pylist(), got.column("sha").to_pylist(), strict=True))
        nothing = hashlib.sha256(b"").hexdigest()
        return [found.get(k, nothing) for k in range(len(ids))]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        self._token_rows(ids)
        got = self._query(DECODE_BYTES)
        found = dict(zip(got.column("row").to_pylist(), got.column("raw").to_pylist(), strict=True))
        return [found.get(k, b"") for k in range(len(ids))]


_CODERS: dict[tuple, Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder; workers are reused, so this is built once in each."""
    if (path, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _groups(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """Consecutive values of about ``most_bytes`` at a time."""
    start, rows, size = 0, [], 0
    for k, cell in enumerate(column):
        value = cell.as_py()
        rows.append(value)
        size += len(value or "")
        if size >= most_bytes:
            yield start, rows
            start, rows, size = k + 1, [], 0
    if rows:
        yield start, rows


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, ids array<long>."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in c.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"]
                )

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<bigint>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each input row: id, text (ids that cut a character give U+FFFD)."""
    ship(rows.sparkSession)
    src = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, public_tokenizers.PATTERN)
        for batch in batches:
            ids = [np.array(x.as_py() or [], "<u4").tobytes() for x in batch.column(1)]
            texts = [b.decode("utf-8", "replace") for b in c.decode(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: id, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                ids = c.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array(c.decoded_sha(ids)),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
