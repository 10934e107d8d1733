"""Substring dedup by MinHash banding of paragraphs.

1. Texts that are equal as a whole are one document, so a hot group of copies is not
   cut up: its copies are removals from their first to their last word.
2. Every line of ``PASSAGE_WORDS`` words or more is a paragraph. Its five-word shingles get
   a MinHash in bands of two whole 32-bit values, whose number is tuned for the recall asked for at
   the threshold. Paragraphs that collide are compared with hubs, not in all pairs
   (``near.link``), confirmed by exact Jaccard, and clustered by components.
3. A passage inside longer lines is found by content-defined pieces of the document's
   words: a cut lies where the hash of five words is the least of a window of ``NEAR``
   positions, and a piece is what lies between two cuts. Equal passages are cut alike, so
   one of ``2 * NEAR + 4`` words (50) or more always holds a whole piece.
4. Both show where to look; the true ends come from the words: every run of
   ``PASSAGE_WORDS`` words within reach of a repeated piece is compared with all others.
   The runs of the smallest doc_id stay and the others are removals; so do the
   paragraphs of a cluster but its first.

Defined results: ids are integers. Null texts and texts of under ``PASSAGE_WORDS`` words have
no passage; a passage that repeats only inside one document is not a removal, and rows that
share a doc_id are one document, each with spans of its own text; so are rows without one, which
rank behind every other; an empty table gives an empty result; other columns
are not read. Shingles, pieces and runs of words are compared by 64-bit hashes, whole texts by
a 64-bit hash and their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.ship import ship
from sentinela.llm.common import documents, drop_written, few_joined, written
from sentinela.llm.near import PART, Linker, band_keys, link, mixed, shingles, signatures, tune, word_ids, words

WIDTH = 5
THRESHOLD = (80, 100)
ROWS = 2
BANDS = tune(0.8, 0.99, ROWS)
BITS = 32  # of a signature value; two of 16 bits are equal by chance in ever more pairs of lines
MISS = 1e-6
NEAR = 23
#: A reported passage has at least so many words that another document has as well.
PASSAGE_WORDS = 20
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id, behind every other


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def pieces(h: np.ndarray) -> np.ndarray:
    """The cuts of shingle hashes ``h``: where a hash is the least of a window of ``NEAR``."""
    if len(h) < NEAR:
        return np.zeros(0, np.int64)
    least = _slide(h, NEAR, np.minimum)
    # The greatest least of the windows that hold a place is its own hash if any window's least is.
    own = _slide(np.concatenate([np.zeros(NEAR - 1, np.uint64), least, np.zeros(NEAR - 1, np.uint64)]), NEAR, np.maximum)
    return np.flatnonzero(own == h)


def _text_ids(text: str | None) -> np.ndarray:
    return word_ids(words(text))


def _spots(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and how many words lie before each line, and before the text's end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.zeros(len(code) + 2, bool)
    word[1:-1] = (code != 32) & ((code < 9) | (code > 13))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end, np.concatenate([[0], np.searchsorted(start, np.flatnonzero(code == 10)), [len(start)]])


def _sources(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(singles, copies). ``singles``: (d, doc, copied, text), one row for each distinct text;
    ``copies``: (doc, of, text), the other rows of a text that several have."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_col).alias("t"), F.length(text_col).alias("size"), F.col(text_col).alias("text"))
    src = src.where("text IS NOT NULL")
    twice = written(src.groupBy("t", "size").agg(F.min("doc").alias("of"), F.count(F.lit(1)).alias("k"), F.max("doc").alias("hi")).where("k > 1").drop("k"), "copies")
    marked = few_joined(src, twice, "t", "size", how="left")
    singles = marked.where("of IS NULL OR doc = of").select(F.xxhash64("doc", "t").alias("d"), "doc", F.coalesce(F.col("of") != F.col("hi"), F.lit(False)).alias("copied"), "text")
    return singles, marked.where("doc <> of").select("doc", "of", "text")


def _pieces_of(singles: DataFrame) -> DataFrame:
    """(digest, doc, d, start, end) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                digests, ds, cuts = [], [], []
                for doc, d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    h = shingles(_text_ids(text.as_py()), WIDTH)
                    cut = pieces(h)
                    if len(cut) > 1:
                        # Shingles overlap, so their sum stands for the piece as it is.
                        digests.append(np.add.reduceat(mixed(h), cut)[:-1])
                        ds.append(np.tile(np.array([[doc], [d]]), len(cut) - 1))
                        cuts.append((cut[:-1], cut[1:]))
                if digests:
                    starts, ends = (np.concatenate(x).astype(np.int32) for x in zip(*cuts, strict=True))
                    cols = [pa.array(np.concatenate(digests).view(np.int64)), *map(pa.array, np.concatenate(ds, axis=1)), pa.array(starts), pa.array(ends)]
                    yield pa.RecordBatch.from_arrays(cols, names=["digest", "doc", "d", "start", "end"])

    return singles.select("doc", "d", "text").mapInArrow(run, "digest bigint, doc bigint, d bigint, start int, end int")


def repeated_pieces(singles: DataFrame) -> DataFrame:
    """(d, hits): the pieces of each text that another document has as well."""
    every = written(_pieces_of(singles), "pieces")
    shared = every.groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("digest")
    found = few_joined(every, written(shared, "shared"), "digest")
    out = written(found.groupBy("d").agg(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("hits")), "hits")  # bounded by the text
    drop_written(every)
    return out


def similar_lines(singles: DataFrame, threshold: tuple[int, int] = THRESHOLD, passage_words: int = PASSAGE_WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(d, alike): the lines of each document in a cluster of different paragraphs of several
    documents: line number, c (smallest document of the cluster), r (not its first paragraph)."""
    lines = singles.select("d", "doc", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.where(F.length("text") >= 2 * passage_words - 1)  # so many words have so many characters
    every = signatures(lines, "d", "text", WIDTH, rows * bands, also=["doc", "line"], bits=BITS)
    # Equal paragraphs are one node, named by the digest of their shingles.
    node = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    every = written(every.select(F.col("id").alias("d"), "doc", "line", node.alias("node"), "n", "sig"), "paragraphs")
    linker = Linker(every.select("node", "n", "sig", "d", "line"), lines.select("d", "line", "text"), ["d", "line"], WIDTH, threshold, rows * bands, MISS, BITS)
    comp = link(every.select("node", F.explode(band_keys(F.col("sig"), rows, bands, BITS)).alias("key")), linker)
    if comp is None:
        drop_written(every)
        return singles.sparkSession.createDataFrame([], "d bigint, alike array<struct<line:int,c:bigint,r:boolean>>")
    mine = few_joined(every.select("d", "doc", "line", "node"), comp, "node")
    first = mine.groupBy("component").agg(F.min(F.struct("doc", "d", "line")).alias("first"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("component", "first")
    entry = F.struct("line", F.col("first.doc").alias("c"), (F.col("first") != F.struct("doc", "d", "line")).alias("r"))
    out = written(mine.join(first, "component").groupBy("d").agg(F.collect_list(entry).alias("alike")), "alike")  # bounded by the text
    drop_written(every)
    return out


def _fields(cell: pa.Array, *names: str) -> list[np.ndarray]:
    """Columns of one row's list of structs."""
    return [cell.values.field(name).to_numpy(zero_copy_only=False) for name in names]


def _reach(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's ``n`` words a passage that holds one of the pieces can have."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(0, start - NEAR), 1)
    np.add.at(step, np.minimum(n, end + NEAR + WIDTH - 1), -1)
    return np.cumsum(step[:n]) > 0


def _windows(own: DataFrame, passage_words: int) -> DataFrame:
    """(key, doc, d, at): every run of ``passage_words`` words within reach of a repeated piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            found = []
            for d, doc, text, hits in zip(*rb.columns, strict=True):
                if not hits.is_valid or len(ids := _text_ids(text.as_py())) < passage_words:
                    continue
                outside = np.concatenate([[0], np.cumsum(~_reach(*_fields(hits, "s", "e"), len(ids)))])
                at = np.flatnonzero(outside[passage_words:] == outside[:-passage_words])
                found.append((shingles(ids, passage_words)[at].view(np.int64), *(np.full(len(at), x.as_py(), np.int64) for x in (doc, d)), at.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["key", "doc", "d", "at"])

    return own.select("d", "doc", "text", "hits").mapInArrow(run, "key bigint, doc bigint, d bigint, at int")


def _repeated_runs(own: DataFrame, passage_words: int) -> DataFrame:
    """(d, seen): where each text has a run that another document has: at, c (smallest document with it)."""
    every = written(_windows(own, passage_words), "windows")
    shared = every.groupBy("key").agg(F.min("doc").alias("c"), F.max("doc").alias("hi")).where("c <> hi").select("key", "c")
    out = written(every.select("key", "d", "at").join(shared, "key").groupBy("d").agg(F.collect_list(F.struct("at", "c")).alias("seen")), "seen")  # bounded by the text
    drop_written(every)
    return out


_KINDS = {"start": pa.int64(), "end": pa.int64(), "n_words": pa.int64(), "component_doc": pa.int64(), "removed": pa.bool_()}


def _spans(rows: DataFrame, id_col: str, passage_words: int) -> DataFrame:
    """Reported runs of (doc, text, of, copied, alike, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            out = []
            for row in range(rb.num_rows):
                doc, text, of, copied = (rb.column(k)[row].as_py() for k in range(4))
                alike, seen = rb.column(4)[row], rb.column(5)[row]
                opens, closes, ends = _spots(text)
                n = len(opens)
                first = np.full(n, _LAST)
                # Runs of words: first, after the last, smallest document that has it, goes.
                runs = [(np.zeros(0, np.int64),) * 4]
                if seen.is_valid:
                    at, c = _fields(seen, "at", "c")
                    runs.append((at, at + passage_words, c, c != doc))
                    least = np.full(n + passage_words - 1, _LAST)
                    least[at + passage_words - 1] = c  # each place has one run
                    first = _slide(least, passage_words, np.minimum)
                if of is not None or copied:
                    runs.append(tuple(np.array([x]) for x in (0, n, doc if of is None else of, of is not None)))
                if alike.is_valid:
                    line, c, r = _fields(alike, "line", "c", "r")
                    runs.append((ends[line], ends[line + 1], c, r))
                for s, e, c, _ in runs[1 + seen.is_valid :]:  # the whole text and lines
                    for k in range(len(s)):
                        np.minimum(first[s[k] : e[k]], c[k], out=first[s[k] : e[k]])
                start, end, _, goes = (np.concatenate(x).astype(np.int64) for x in zip(*runs, strict=True))
                step = np.zeros((2, n + 1), np.int64)
                np.add.at(step, (goes, start), 1)
                np.add.at(step, (goes, end), -1)
                stays, gone = (np.cumsum(x[:n]) > 0 for x in step)
                kind = np.where(gone, 2, stays)  # what another document keeps goes
                edge = np.flatnonzero(np.diff(kind, prepend=0, append=0)).tolist()
                runs = [(s, e) for s, e in zip(edge, edge[1:], strict=False) if kind[s]]
                whole: list[list[tuple[int, int]]] = []
                for x in runs:
                    if whole and whole[-1][-1][1] == x[0]:
                        whole[-1].append(x)
                    else:
                        whole.append([x])
                for part in whole:
                    if part[-1][1] - part[0][0] >= passage_words:
                        out += [(doc, int(opens[s]), int(closes[e - 1]), e - s, int(first[s:e].min()), bool(kind[s] == 2)) for s, e in part]
            cols = list(zip(*out, strict=True)) or [()] * 6
            ids = [pa.array([None if x == _LAST else x for x in cols[k]], pa.int64()) for k in (0, 4)]
            yield pa.RecordBatch.from_arrays([ids[0], *(pa.array(cols[k], pa.int64()) for k in (1, 2, 3)), ids[1], pa.array(cols[5], pa.bool_())], names=[id_col, *_KINDS])

    return rows.select("doc", "text", "of", "copied", "alike", "seen").mapInArrow(run, f"`{id_col}` bigint, start bigint, end bigint, n_words bigint, component_doc bigint, removed boolean")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Repeated passages: one row for each maximal run of repeated words of a document, in
    passages of ``passage_words`` words or more: id, start, end (code points), n_words,
    component_doc (smallest document that has part of it), removed (false where it stays)."""
    ship(docs.sparkSession)
    singles, copies = _sources(docs, id_col, text_col)
    hits, alike = repeated_pieces(singles), similar_lines(singles, passage_words=passage_words)
    used = hits.select("d").union(alike.select("d")).distinct().withColumn("hit", F.lit(True))
    own = few_joined(singles, used, "d", how="left").where("copied OR hit").drop("hit").dropDuplicates(["d"])
    own = written(own.join(hits, "d", "left").join(alike, "d", "left"), "own")
    seen = _repeated_runs(own, passage_words)
    none = lambda df, name: F.lit(None).cast(dict(df.dtypes)[name]).alias(name)
    mine = own.join(seen, "d", "left").select("doc", "text", F.lit(None).cast("long").alias("of"), "copied", "alike", "seen")
    rest = copies.select("doc", "text", "of", F.lit(True).alias("copied"), none(mine, "alike"), none(mine, "seen"))
    return _spans(mine.union(rest), id_col, passage_words).distinct()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir))
