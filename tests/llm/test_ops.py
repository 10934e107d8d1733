"""Brute-force comparisons and edge cases of the training-data operators.

The fixture has nulls in every column, empty, blank and very long texts, ties,
rows repeated whole and extra columns whose names clash with internal ones.
"""

import hashlib
import math
import operator
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sentinela.llm import bpe, common, ctw, exact_dedup, licences, mixing, near, near_dedup, pii, quality_rules, substring_dedup, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, id string"
RNG = random.Random(7)
VOCAB = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def fixture_rows():
    rng = random.Random(11)
    passage = prose(70, rng)
    base = [prose(120, rng) for _ in range(6)]
    texts = [None, "", " \n\t ", "word", "Word", base[0], base[0] + " ", base[0].upper(), base[1], base[1] + " tail", base[2], "x" * 20_000, prose(20_000, rng)]
    for k in range(8):  # near copies that differ from each other
        w = base[3].split()
        w[10 + k] = "changed"
        texts.append(" ".join(w))
    texts += [prose(40, rng) + ". " + passage + ". " + prose(30, rng) for _ in range(3)]
    texts += ["mail me: a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567", "line\n" * 60, "Released under the MIT License.\nother", "IBAN DE89 3704 0044 0532 0130 00 é 漢字 😀"]
    rows = [(i, t, None if i % 5 else "en", None if i % 7 == 0 else f"s{i % 3}", None, "k", "n", "i") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "null id text here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in fixture_rows():
        groups["".join(c for c in (r[1] or "") if c not in " \t\n\x0b\x0c\r")].append(r)
    got = exact_dedup.dedup(docs, bucket_entries=2).collect()
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    assert len(got) == len(fixture_rows())
    for body, rows in groups.items():
        g = by[hashlib.sha256(body.encode()).hexdigest()]
        best = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert len(g) == len(rows) and sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(rows)}
        assert {r["keep_id"] for r in g} == {best[0]}
    assert exact_dedup.dedup(empty).count() == 0


def test_directory_doubles():
    cells = {i: 10 for i in range(16)}
    b = exact_dedup.split_directory(cells, 4, 25)
    assert all(high - low == 1 for low, high, _ in b) and len(b) == 8
    assert exact_dedup.split_directory({3: 1000}, 4, 25)[0][2] >= 1
    # Ranges cover every cell once, and only cells that can't be split are overfull.
    b = exact_dedup.split_directory({0: 30, 1: 1, 9: 12, 12: 12, 15: 3}, 4, 25)
    assert [c for low, high, _ in b for c in range(low, high + 1)] == list(range(16)) and b[0] == (0, 0, 4)


def test_directory_is_the_way_to_the_index(docs):
    entries, directory, index = exact_dedup.build_index(docs, bucket_entries=3)
    rows = index.collect()
    assert len(directory.buckets) > 2 and len({r["bucket"] for r in rows}) > 2
    held = Counter(r["bucket"] for r in rows)
    assert max(held.values()) <= 3 and sum(r["n"] for r in rows) == entries.count()
    for r in rows:
        low, high, local = directory.buckets[r["bucket"]]
        assert low <= (r["key"] % 2**64) >> (64 - directory.depth) <= high and r["local_depth"] == local


def test_quality_rules(docs, empty):
    got = quality_rules.verdict(common.written(quality_rules.ledger(docs), "ledger"))
    rows = {r["doc_id"]: r for r in got.collect()}
    for r in fixture_rows():
        w = re.findall(common.WORD, r[1] or "")
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {p for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        x = rows[r[0]]
        assert (x["n_words"], x["word_chars"], x["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover)), r[0]
        assert x["kept"] == passes_quality(r[1]), r[0]
        lines = [v for v in (r[1] or "").split("\n") if re.search(common.WORD, v)]
        assert (x["n_symbols"], x["n_dup_lines"]) == (sum((r[1] or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))), r[0]
    a = {r["rule"]: r for r in quality_rules.ablation(got).collect()}
    bits = [r["failures"] & quality_rules.PRODUCTION.mask for r in got.collect()]
    for k, (name, _) in enumerate(quality_rules.RULES):
        if quality_rules.PRODUCTION.mask >> k & 1:
            own = [b ^ 1 << k for b in bits if b >> k & 1]
            want = (len(own), own.count(0), reduce(operator.or_, own, 0), reduce(operator.and_, own) if own else 0)
            assert (a[name]["failed"], a[name]["failed_alone"], a[name]["ever_with"], a[name]["always_with"]) == want, name
    assert set(a) == {n for k, (n, _) in enumerate(quality_rules.RULES) if quality_rules.PRODUCTION.mask >> k & 1}
    assert {r["failed"] for r in quality_rules.ablation(quality_rules.ledger(empty)).collect()} == {0}
    assert quality_rules.ledger(empty).count() == 0


def test_pii(docs, empty):
    for r in pii.scan(docs).collect():
        text = next(x[1] for x in fixture_rows() if x[0] == r["doc_id"])
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE_KINDS] == pii.brute(text)
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choices("a@.-1290 +()%", k=rng.randint(0, 60)))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == pii.brute(t), t
    kinds = [s["kind"] for s in pii.scan(docs.where("text LIKE '%IBAN%'")).first()["spans"]]
    assert kinds == ["iban"]
    found = lambda t: [(s[0], s[3]) for s in pii.find_spans(t)]
    key = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71"
    assert found(f'the token = "{key}" here') == [("secret", 0.7)] and found(f"the {key} here") == [] and found(f"tokens {key}") == []
    assert found("my ssn 123-45-6789") == [("national_id", 0.7)] and found("lessness 123-45-6789") == []  # whole words only
    assert found("from host 10.0.0.1") == [("ip", 0.9)] and found("a ship 10.0.0.1") == [("ip", 0.6)]
    assert pii.redact(docs.sparkSession.createDataFrame([(1, "card 4111 1111 1111 1111.4.5.6")], "doc_id long, text string")).first()["text"].startswith("card <card>")
    assert pii.redact(docs.where("text LIKE 'mail me%'")).first()["text"].startswith("mail me: <email> or <ip>, card <card>")
    assert pii.scan(empty).count() == 0


def test_licences(docs, empty):
    got = licences.scan(docs)
    assert {r["licences"] for r in got.collect()} == {"", "MIT"} and got.where("licences = 'MIT'").count() == 1
    one = docs.sparkSession.createDataFrame([(1, "Copyright (c) 2020 X\n" + licences._MIT_BODY.upper().replace("SUBLICENSE", "sub-licence"))], "doc_id long, text string")
    assert licences.scan(one).first()["whole"] == "MIT"
    assert licences.scan(empty).count() == 0
    notice = "Licensed under the MIT License."
    rows = [(None, notice), (None, "none"), (1, notice), (1, notice), (1, "ISC License\nSPDX-License-Identifier: ISC"), (2, None)]
    found = Counter((r["doc_id"], r["licences"], r["n_hits"]) for r in licences.scan(docs.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {(None, "MIT", 1): 1, (None, "", 0): 1, (1, "MIT", 1): 2, (1, "ISC", 1): 1, (2, "", 0): 1}


def test_licences_full_and_embedded(spark):
    own = {"MIT": "MIT License\n\nCopyright (c) 2020 X\n\n" + licences._MIT_BODY, "BSD-3-Clause": licences._BSD_HEAD + licences._BSD_THIRD + licences._BSD_TAIL, "ISC": licences._ISC_BODY, "Unlicense": licences._UNLICENSE}
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        path = pathlib.Path("/usr/share/common-licenses", file)
        if path.exists():
            own[name] = path.read_text("utf-8")
    rows = [(f"{name} whole", t) for name, t in own.items()] + [(f"{name} part", f"Some words.\n\nMore of them.\n\n{t}\n\nAnd the end.") for name, t in own.items()]
    rows.append(("none", "Some words.\n\n" + licences._MIT_BODY.replace("free of charge", "for a fee")))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name in own:
        assert got[f"{name} whole"]["whole"] == name and name in got[f"{name} part"]["licences"].split(","), name
        assert got[f"{name} part"]["whole"] is None
    assert got["none"]["licences"] == ""


def test_bpe_is_the_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r[0]: r[1] or "" for r in fixture_rows()}
    for r in bpe.round_trip(docs, path).collect():
        ids = np.array(e.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    some = docs.where("doc_id IN (3, 5, 27)")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(some, path), path).collect()}
    assert back == {i: texts[i] for i in back} and bpe.encode(empty, path).count() == 0


def test_bpe_long_words():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(43)
    some = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    texts = ["x" * 20_000, "the" * 6000, "ab" * 5000, "é漢" * 2000, some("abcdefghijklmnopqrstuvwxyz", 20_000), some(["in", "ing", "er", "st", "tion"], 3000), some("st", 3000), some("aé", 700)]
    texts += [some(rng.sample("aenorstiLTé", 2), rng.randint(513, 900)) for _ in range(40)]
    got = bpe.coder(path, public_tokenizers.PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.encode_ordinary(t) for t in texts]


def test_bpe_separators_are_no_white_space():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(29)
    texts = ["\n\n\x1d"] + ["".join(rng.choices(" \n\t\x0b\r\x85\xa0\x1c\x1d\x1e\x1fa", k=rng.randint(1, 12))) for _ in range(3000)]
    got = bpe.coder(path, public_tokenizers.PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.encode_ordinary(t) for t in texts]


def test_mixing(docs, empty):
    p = mixing.plan(docs, max_repetition=2.0)
    shown = Counter(r["doc_id"] for r in p.collect())
    assert set(shown) == {r[0] for r in fixture_rows()}  # the default budget leaves nothing out
    s = mixing.shares(docs)
    for a in (mixing.bisect_exponent(s, max_repetition=1.5),):
        most = max(r["tokens"] for r in s.collect())
        reps = lambda x: max((r["tokens"] / most) ** (x - 1) for r in s.collect() if r["tokens"])
        assert reps(a) <= 1.5 and (a == 0 or reps(a - 1 / mixing.GRID) > 1.5)
    total = sum(r["tokens"] for r in s.collect())
    cut = mixing.plan(docs, budget=total // 2).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r["n"] for r in cut) <= total // 2
    assert sorted(mixing.mix(docs).columns) == sorted(docs.columns)
    # Each row has shows of its own, and the places are those of the plan.
    rows = [(1, "a b c", "s"), (1, "d e", "s"), (None, "f", "s"), (None, "g", "s"), (2, "h i j k l m n o p q r s", "t")]
    one = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_name", F.lit(0))
    placed = mixing.mix(one, places=True).collect()
    times = Counter(r["text"] for r in placed)
    assert set(times) == {r[1] for r in rows} and max(times.values()) <= 3 and set(placed[0].asDict()) == {*one.columns, "mix_epoch", "mix_block", "mix_position"}
    assert len({(r["source"], r["mix_epoch"], r["mix_block"], r["mix_position"]) for r in placed}) == len(placed) > 5
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def jaccard_components(rows, width, den, num):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in (t or "").split()]
        sets[i] = {tuple(w[k : k + min(width, len(w))]) for k in range(max(0, len(w) - width) + 1)} if w else set()
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(docs, empty):
    rows = [(r[0], r[1]) for r in fixture_rows() if r[0] is not None]
    want = jaccard_components(rows, 2, 100, 80)
    got = near_dedup.near_dedup(docs.where("doc_id IS NOT NULL")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_dedup(docs).where("doc_id IS NULL").count() == 1
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_by_differences(spark, monkeypatch):
    # One hub a bucket and then differences only: strays that are linked with each other or with members the hub isn't.
    rng = random.Random(31)
    base, rows = [f"v{k}" for k in range(60)], []

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"n{rng.randrange(100000)}"
        return w

    for i in range(150):
        rows.append((i, " ".join(edited(base, rng.randint(0, 9)))))
    for i in range(150, 220):  # copies of copies
        rows.append((i, " ".join(edited(rows[rng.randrange(len(rows))][1].split(), rng.randint(0, 4)))))
    monkeypatch.setattr(near, "YIELD", 2.0)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_components(rows, 2, 100, 80)


def test_near_dedup_rows_of_one_id(spark):
    rng = random.Random(37)
    a, b = prose(60, rng), prose(60, rng)
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (None, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 1, False), (True, 0, 0, True), (True, 0, 1, False)]


def test_near_dedup_loses_few_pairs_by_batches():
    n, alive = near_dedup.BATCH, np.ones(1)
    level = near_dedup.THRESHOLD[0] / near_dedup.THRESHOLD[1]
    agree = [math.comb(n, k) * level**k * (1 - level) ** (n - k) for k in range(n + 1)]
    for at in range(n, near_dedup.BANDS * near_dedup.ROWS + 1, n):
        alive = np.convolve(alive, agree)
        alive[: near.pass_mark(at, level, near_dedup.MISS)] = 0
    assert 1 - alive.sum() < 1e-5  # of pairs exactly at the threshold


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_substring_dedup(docs, empty):
    got = substring_dedup.removals(docs.where("doc_id IS NOT NULL")).collect()
    found = {r["doc_id"] for r in got}
    assert set(range(21, 24)) <= found and not found & {0, 1, 2, 3, 4, 10, 11, 12, 24, 25, 26, 27}
    assert substring_dedup.removals(empty).count() == 0


def test_substring_dedup_planted(spark):
    rng = random.Random(51)
    vocab = [f"w{k}" for k in range(5000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], {}
    for k in range(150):  # 51 words inside two unrelated texts
        passage = some(51)
        for doc in (2 * k, 2 * k + 1):
            before, after = some(rng.randint(0, 80)), some(rng.randint(0, 80))
            rows.append((doc, " ".join(before + passage + after)))
            want[doc] = (len(" ".join([*before, ""])), len(" ".join(before + passage)), 51, 2 * k, doc % 2 == 1)
    got = defaultdict(list)
    for r in substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    # A neighbouring word may be equal by chance.
    assert set(got) == set(want) and all(len(x) == 1 for x in got.values())
    for doc, w in want.items():
        g = got[doc][0]
        assert g[0] <= w[0] and g[1] >= w[1] and g[2] <= w[2] + 2 and g[3:] == w[3:], doc


def test_substring_dedup_rows_of_one_id_and_nulls(spark):
    rng = random.Random(53)
    a, b, c = prose(80, rng), prose(90, rng), prose(60, rng)
    rows = [(1, a), (1, b + " " + c), (2, c + "\n" + b), (3, a), (None, a), (4, None), (5, prose(19, rng)), (6, ""), (7, a), (7, a)]
    got = defaultdict(list)
    for r in substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("hits", F.lit("x"))).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["n_words"], r["component_doc"], r["removed"]))
    whole = (0, len(a), 80, 1)
    assert sorted(got[1]) == sorted([(*whole, False), (0, len(b) + 1 + len(c), 150, 1, False)]) and got[3] == got[None] == got[7] == [(*whole, True)]
    assert all(x[3:] == (1, True) for x in got[2]) and sum(x[2] for x in got[2]) == 150 and set(got) == {1, 2, 3, 7, None}


def test_substring_dedup_similar_lines(spark):
    rng = random.Random(59)
    line = prose(100, rng).split()
    other = list(line)
    other[50] = "changed"
    rows = [(1, prose(30, rng) + "\n" + " ".join(line)), (2, " ".join(other) + "\n" + prose(40, rng)), (3, prose(150, rng))]
    got = {r["doc_id"]: (r["n_words"], r["component_doc"], r["removed"]) for r in substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (100, 1, False), 2: (100, 1, True)}


def test_substring_dedup_unrelated_lines_share_no_bucket(spark, monkeypatch):
    rng = np.random.default_rng(61)
    # 8,000 lines without a common shingle; with bands of 32 bits dozens of pairs would meet by chance.
    rows = [(k, "\n".join(" ".join(f"{x:x}" for x in line) for line in rng.integers(0, 1 << 40, (4, 100)))) for k in range(2000)]
    rows += [(5000, rows[0][1] + " more"), (5001, rows[1][1] + " more")]
    met = []

    def spy(keyed, linker):
        met.append(keyed.groupBy("key").agg(F.collect_set("node").alias("x")).where("size(x) > 1").count())

    monkeypatch.setattr(substring_dedup, "link", spy)
    assert substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).count() > 0
    assert 0 < met[0] <= 2 * substring_dedup.BANDS  # of the two lines with a near copy


def test_ctw_against_recursion(spark, empty):
    rows = [(i, t) for i, t in enumerate([None, "", "abab abba", "abab baba", "banana band", "banana band a", "xyz abab", "ab"])]
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=12, shards=3).collect()}
    depth, counts, kids = ctw.DEPTH, defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(t):
        b = b"\xff" * depth + b" ".join(ctw.tokens_of(t)) + b"\xff"
        for i in range(depth, len(b)):
            for k in range(8):
                yield b[i - depth : i], (k, b[i] >> (8 - k)), b[i] >> (7 - k) & 1

    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for c, pre, bit in steps(t):
                for d in range(depth + 1):
                    counts[c[depth - d :], pre][bit] += 1
                    if d:
                        kids[c[depth - d + 1 :], pre].add(c[depth - d :])

    def kt(n):
        a, b = counts[n]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(n):
        k = kt(n)
        return k if len(n[0]) == depth else float(np.logaddexp(k, sum(weighted((c, n[1])) for c in kids[n])) - math.log(2))

    for i, t in rows:
        total = 0.0
        for c, pre, bit in steps(t):
            p = None
            for d in range(depth, -1, -1):
                n = (c[depth - d :], pre)
                if n in counts:
                    a, b = counts[n]
                    q = ((b if bit else a) + 0.5) / (a + b + 1)
                    w = math.exp(kt(n) - math.log(2) - weighted(n)) if p is not None else 1.0
                    p = q if p is None else w * q + (1 - w) * p
            total += math.log10(0.5 if p is None else p)
        assert got[i]["score"] == pytest.approx(total, rel=1e-6) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert ctw.score(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    trap = "x" * 990 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a/1", trap), (2, "http://a/2", trap), (3, None, None), (4, "http://a/\n4", ""), (5, "http://a/5", "é" * 600), (6, "http://a/6", "é" * 600), (6, "http://a/6", "é" * 600), (None, "u", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    by = {r["page_id"]: r for r in got}
    six = sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 6)
    assert len(got) == 8 and six == [("response", None), ("revisit", 6)]  # a row repeated whole is a capture of its own
    assert by[1]["record_type"] == "revisit" and by[1]["refers_to"] == 2 and by[2]["record_type"] == "response"
    assert bytes(by[2]["response"]["payload"]).decode() == trap and by[5]["payload_bytes"] == 1200 and by[5]["refers_to"] == 6
    for r in rows:
        assert by[r[0]]["payload_digest"] == hashlib.sha1((r[2] or "").encode()).hexdigest()
    assert all(r["request"] and r["metadata"] for r in got)
    tie = spark.createDataFrame([(7, "http://a/x", "t" * 1200), (7, "http://a/y", "t" * 1200)], "page_id long, url string, html string")
    warc.write_archives(tie, str(tmp_path / "t"))
    assert sorted(r["record_type"] for r in warc.assemble(warc.read_archives(spark, str(tmp_path / "t"))).collect()) == ["response", "revisit"]
    warc.write_archives(pages, str(tmp_path / "s"), file_bytes=1)  # a file for each page
    assert len(list((tmp_path / "s").glob("part-*"))) == 8
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "e"))).count() == 0


def test_pipeline_stages_pass_empty_and_small(docs, empty):
    import corpus_pipeline as cp

    spark = docs.sparkSession
    for first in (docs, empty):
        d = first
        for name, stage in cp.STAGES:
            d = common.written(stage(spark, d, ""), name)
            if name != "bpe":
                assert sorted(d.columns) == sorted(first.columns)
        assert d.count() == 0 if first is empty else d.count() > 0


def passes_quality(text):
    t = text or ""
    w = re.findall(common.WORD, t)
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {p for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(common.WORD, x)]
    chars = sum(map(len, w))
    return not (
        len(w) < 50 or 100 * len(cover) > 50 * len(w) or sum(t.count(c) for c in "#*$%&|<>") > len(w)
        or chars < 2 * len(w) or chars > 30 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines)
        or 5 * sum(any(c.isalpha() for c in x) for x in w) < 2 * len(w) or 10 * sum(x.rstrip().endswith(("...", "…")) for x in lines) > 3 * len(lines)
    )


def test_pipeline_is_brute_force(spark):
    import corpus_pipeline as cp

    rng = random.Random(23)
    a, b, c, d, e, f = (prose(90, rng) for _ in range(6))
    near = a.split()
    near[-1] = "changed"
    rows = [
        (1, a, "s"), (1, a, "s"), (2, " ".join(near), "s"),  # repeated whole; a near copy
        (3, b, "s"), (3, "too short", "s"), (3, c, "t"),  # one id, three texts
        (None, d, "s"), (None, "rejected", "s"), (None, e, "t"), (None, d + " ", "t"), (4, f, None), (5, f.replace(" ", "  ", 3), None), (6, None, "s"),
    ]
    first = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    after = {}
    d_ = first
    for name, stage in cp.STAGES:
        d_ = common.written(stage(spark, d_, ""), name)
        after[name] = Counter(map(tuple, d_.collect()))
    good = [r for r in rows if passes_quality(r[1])]
    assert after["quality_rules"] == Counter(good)
    groups = defaultdict(list)
    for r in good:
        groups["".join((r[1] or "").split())].append(r)
    single = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert after["exact_dedup"] == Counter(single)
    single.sort(key=lambda r: (r[0] is None, r[0] or 0))
    part = jaccard_components([(k, r[1]) for k, r in enumerate(single)], 5, 100, 80)
    apart = [r for k, r in enumerate(single) if part[k][1] == k]
    assert after["near_dedup"] == Counter(apart) and len(apart) < len(single)
    shown = after["source_mixing"]
    assert set(shown) == set(apart)
    # Whole epochs and a part of one more: rows of a source are shown equally often, or once more.
    for source in {r[2] for r in apart}:
        times = [n for r, n in shown.items() if r[2] == source]
        assert max(times) - min(times) <= 1 and max(times) <= 3
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r, n in shown.items():
        ids = np.array(enc.encode_ordinary(r[1]), "<u4")
        want[r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += n
    assert after["bpe"] == want
