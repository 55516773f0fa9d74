"""The training-data operators against brute force, exact round trips and held-out accuracy, with nulls, empty and long texts, ties, repeated
rows, empty tables and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempograph.llm import base, chains, hamming, jaccard, linededup, mixing, packing, quality, tokens, toxicity, vectors, wavelet
from tempograph.llm.queries import WEIGHTS, domain_of
from tempograph.llm.textbytes import utf8

WORDS = [f"w{i}" for i in range(60)]
#: columns whose names operators use themselves
CLASH = ["n", "length", "chunk", "bucket", "w", "d", "l", "key", "component_id", "shard", "_gone", "held_out"]


def docs_of(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def texts(n=40, seed=5):
    rng = random.Random(seed)
    base_ = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 120))) for _ in range(n)]
    out = list(enumerate(base_))
    for k in range(n, n + 25):  # near copies
        w = rng.choice(base_).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((k, " ".join(w)))
    out += [(100, None), (101, ""), (102, "   \n\t"), (103, "one"), (104, "ONE"), (105, base_[0]), (106, "long " * 30_000), (106, "long " * 30_000), (107, "a\nb  c\n\n d")]
    return out


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---------------------------------------------------------------- shared parts


@pytest.mark.parametrize("one_task", [0, base.ONE_TASK])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(base, "ONE_TASK", one_task)
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 3)]
    s = base.Scratch(spark, "t")
    got = {r.id: r.component_id for r in base.components(s, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), 20: 20, 21: 20}
    assert base.components(s, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_librarys(name):
    odd = ["a  b c", "  x", "x ", "a\n\nb", "é́ é", "it's  don't x y\tz", "<|endoftext|> hi", "ΑΣ ΟΔΟΣ σ", "", None, " ", "a\x1cb c\x85d e f", "'s 't", "x.)y z.!", "...", ".a", "don't. we'll,", "—x— “q”. r", "\nq\n r\n", "字 词。a. b"]
    rng = random.Random(1)
    odd += ["".join(rng.choice(" \n.,!'abcÉß1- ") for _ in range(60)) for _ in range(300)]
    e = tokens.Encoder(name)
    for _ in range(2):
        ids, many = e.encode(*utf8(pa.array(odd)))
        ends = np.cumsum(many)
        assert [ids[q - n : q].tolist() for q, n in zip(ends, many, strict=True)] == [x.ids for x in e.tok.encode_batch([t or "" for t in odd], add_special_tokens=False)]


# ---------------------------------------------------------------- 1 and 8


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base_ = rng.normal(size=(60, 16))
    x = [*base_, *(base_[rng.integers(0, 60, 60)] + rng.normal(size=(60, 16)) * 0.05), base_[3], base_[3]]
    rows = [(i, [float(v) for v in y], i % 2 if i < 120 else 1) for i, y in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, [1.0, None] * 8, 1), (None, rows[0][1], 0), (205, [1.0], 1), (206, [], 1), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit(7))
    got = {}
    for r in vectors.near_duplicates(df, 0.98, tables=8, probes=3).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    ok = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and i not in (200, 201, 202, 204, 206)]
    pairs, links = [], defaultdict(int)
    for a in range(len(ok)):
        for b in range(a):
            (i, u, p), (j, v, q) = ok[a], ok[b]
            if p == q and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    comp = union_find(pairs, {i for i, _, _ in rows if i is not None})
    for i in comp:
        n = links[i] // (2 if i == 5 else 1)
        assert {(n if i == 5 else links[i], comp[i], comp[i] == i)} == {(x[0] if i != 5 else n, x[1], x[2]) for x in got[i]}, i
    assert got[None] == [(0, None, False)]
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=16) + rng.normal(size=(60, 16)) * 0.01
    df = spark.createDataFrame([(i, [float(v) for v in y], 0) for i, y in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()} == {(59, 0)}


@pytest.mark.parametrize("shard", [hamming.SHARD, 200])
def test_hamming(spark, monkeypatch, shard):
    monkeypatch.setattr(hamming, "SHARD", shard)
    monkeypatch.setattr(hamming, "FEW", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40))
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(None, [1.0] * 40), (301, None), (302, [float("nan")] * 40), (303, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bits", F.lit("q"))
    got = defaultdict(list)
    for r in hamming.top_k(df, k=5, every=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbour_id))
    for q in range(0, 300, 50):
        assert got[q] == sorted((int(((x[q] > 0) != (x[j] > 0)).sum()), j) for j in range(300) if j != q)[:5]
    assert hamming.top_k(df.where("false")).count() == 0
    again = df.unionByName(df.where("vec_id in (0, 50, 7)")).unionByName(df.where("vec_id = 9").withColumn("vec_id", F.lit(0).cast("long")))
    lists = defaultdict(list)
    for r in hamming.top_k(again, k=5, every=50).collect():
        lists[r.query_id].append(r["rank"])
    assert {q: sorted(v) for q, v in lists.items()} == {q: [1, 2, 3, 4, 5] for q in range(0, 300, 50)}
    few = hamming.top_k(df.where("vec_id in (0, 1)"), k=5, every=50).collect()
    assert [(r.query_id, r.neighbour_id) for r in few] == [(0, 1)]


# ---------------------------------------------------------------- 2


def brute_matches(rows, num=4, den=5):
    lines = [(i, n, frozenset(w for w in re.split(r"[ \t\x0b\x0c\r]", line) if w)) for i, t in rows if i is not None for n, line in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    first = lambda k, s: next(((j, m) for j, m, t in lines[:k] if den * len(s & t) >= num * len(s | t)), None)
    return {(i, n): at for k, (i, n, s) in enumerate(lines) if (at := first(k, s))}


def brute_lines(rows):
    return set(brute_matches(rows))


def line_docs(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(pool).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(rng.choice([" ", "\t"]).join(w))
        rows.append((i, "\n".join(out)))
    return rows + [(None, rows[0][1]), (50, None), (51, ""), (52, "\n\n \n"), (53, "x " * 5000)]


@pytest.mark.parametrize(("seed", "small", "hot", "num", "den"), [(1, 64, 10**6, 4, 5), (2, 2, 10**6, 4, 5), (3, 1, 1, 4, 5), (4, 1, 2, 3, 4), (5, 3, 10**6, 9, 10), (6, 64, 1, 1, 1)])
def test_lines(spark, monkeypatch, seed, small, hot, num, den):
    monkeypatch.setattr(linededup, "SMALL", small)
    monkeypatch.setattr(linededup, "HOT", hot)
    rows = line_docs(seed)
    got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in linededup.removed_lines(docs_of(spark, rows), num, den).collect()}
    assert got == brute_matches(rows, num, den)


def test_lines_of_one_group(spark, monkeypatch):
    """Variants of a line, some of them near no earlier one but the group's later ones, in lists of any length."""
    rng = random.Random(8)
    base_ = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = list(base_)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(30)] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([*base_[:24], *(f"q{i}x{j}" for j in range(i % 9))])) for i in range(60, 110)]
    want = brute_matches(rows)
    assert len({m for m in want.values()}) > 3
    for small in (1, 4, 64):
        monkeypatch.setattr(linededup, "SMALL", small)
        got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in linededup.removed_lines(docs_of(spark, rows)).collect()}
        assert got == want


@pytest.mark.parametrize(("num", "den"), [(1, 2), (2, 3), (6, 5)])
def test_lines_refuse_other_thresholds(spark, num, den):
    with pytest.raises(ValueError, match="threshold"):
        linededup.removed_lines(docs_of(spark, [(1, "a b")]), num, den)


def test_lines_leave_texts(spark):
    rows = line_docs(7)
    gone = brute_lines(rows)
    want = {}
    for i, t in rows:
        left = t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if t is None or left == t or left.split():
            want[i] = left
    out = linededup.without_repeats(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert linededup.without_repeats(docs_of(spark, rows).where("false")).count() == 0


# ---------------------------------------------------------------- 3 and 4


def ids_of(name, rows, end):
    t = tokens.Encoder(name).tok
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    rows = texts()
    want = defaultdict(list)
    for i, ids in ids_of("byte_bpe_50k.json", rows, 0):
        want[i].append(ids)
    got = packing.pack(docs_of(spark, rows), "byte_bpe_50k.json", 0, 256).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        assert r.ids_crc32 == crc(want[r.doc_id][0][r.start : r.start + r.length])
    for i, w in want.items():
        n = len(w[0])
        k = -(-n // 256)
        lengths = [n - 256 * (k - 1)] + [256] * (k - 1)
        assert sorted(p[:3] for p in parts[i]) == sorted([(j, sum(lengths[:j]), lengths[j]) for j in range(k)] * len(w))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= 1.02 * -(-sum(len(x) for w in want.values() for x in w) // 256) + 1
    assert packing.pack(docs_of(spark, rows).where("false"), "byte_bpe_50k.json").count() == 0


def test_plan_uses_every_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 5000):
        hist = np.bincount(np.clip(rng.lognormal(4, 1, n).astype(int), 1, 256), minlength=257)
        made = np.zeros(257, int)
        groups = packing.plan(hist, 256)
        for r, lengths in groups:
            assert sum(lengths) <= 256
            np.add.at(made, lengths, r)
        assert (made == hist).all()
        assert sum(r for r, _ in groups) <= 1.01 * -(-(hist * np.arange(257)).sum() // 256) + 1


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


@pytest.mark.parametrize("ranges", [wavelet.RANGES, 2])
def test_wavelet_round_trip(spark, monkeypatch, ranges):
    monkeypatch.setattr(wavelet, "RANGES", ranges)
    rows = [*texts(), (None, "no id"), (3, "again")]
    got = wavelet.round_trip(docs_of(spark, rows), "word_bpe_49k.json", 2, shard_bytes=40_000).collect()
    want = sorted(ids_of("word_bpe_49k.json", rows, 2), key=lambda x: (x[0] is not None, x[0] or 0))
    at, places = 0, []
    for i, ids in want:
        places.append((i if i is not None else -1, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(places)
    ends = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == ends
        ends += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None] == [i for i, _ in want if i is not None]
    assert wavelet.round_trip(docs_of(spark, rows).where("false"), "word_bpe_49k.json", 2).count() == 0


def test_wavelet_file():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.3, 200_000).clip(max=5000).astype("<u2")
    w = wavelet.WaveletFile(wavelet.build(ids, np.arange(2), np.array([True, False]), np.array([150_000, 50_000])))
    assert (w.tokens() == ids).all() and w.docs.tolist() == [0, 1] and w.known.tolist() == [True, False]
    for i in (0, 1, 65_535, 65_536, 199_999):
        assert w.access(i) == ids[i]
    for t in (1, 2, 77, 5000):
        assert w.count(t) == (ids == t).sum() and w.count(t, 1000, 150_000) == (ids[1000:150_000] == t).sum()
        at = np.flatnonzero(ids == t)
        for j in (0, len(at) // 2, len(at) - 1):
            assert w.select(t, j) == at[j]
    assert w.count(60_000) == 0
    with pytest.raises(IndexError):
        w.select(1, 10**9)
    empty = wavelet.WaveletFile(wavelet.build(np.zeros(0, "<u2"), np.zeros(0), np.zeros(0, bool), np.zeros(0)))
    assert len(empty.tokens()) == 0 and empty.count(1) == 0


# ---------------------------------------------------------------- 5 and 6


def labelled(spark, good, bad, n=300):
    rng = random.Random(9)
    rows, lab = [], []
    for i in range(n):
        y = i % 3 > 0
        rows.append((i, good(rng) if y else bad(rng)))
        lab.append((i, int(y)))
    rows += [(1000, None), (1001, ""), (None, "x y"), (5, rows[5][1]), (1002, "z" * 200_000)]
    return rows, spark.createDataFrame([*lab, (5, None), (7, 0), (7, 1), (None, 1)], "doc_id long, y int").withColumn("text", F.lit("no"))


def test_quality(spark):
    good = lambda r: " ".join(r.choice(WORDS) + r.choice("abcdefg") for _ in range(r.randint(40, 200)))
    bad = lambda r: " ".join(r.choice(WORDS).upper() + "!!" for _ in range(r.randint(40, 200)))
    rows, labels = labelled(spark, good, bad)
    docs = docs_of(spark, rows)
    out = quality.score(docs, labels, "y").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([(r.predicted == 1) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    kept = quality.keep_good(docs, labels, "y")
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert quality.score(docs.where("false"), labels, "y").count() == 0
    assert {r.score for r in quality.score(docs, labels.where("y = 1"), "y").select("score").distinct().collect()} == {1.0}


def test_labelled_sample_is_bounded(spark):
    from tempograph.llm import labelled

    docs = spark.range(5000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    docs = docs.unionByName(docs_of(spark, [(i, "x" * 100) for i in range(10, 60)], clash=False).select("doc_id", "text")).unionByName(docs_of(spark, [(3, "é" * 60_000)], clash=False).select("doc_id", "text"))
    labels = docs.select("doc_id").distinct().withColumn("y", (F.col("doc_id") % 2).cast("int"))
    got, y, _ = labelled.sample(docs, labels, "y", 20, 8192)
    assert len(got) == len(y) <= 40 and max(len(t.encode()) for t in got) <= 8192 + 8
    assert sum(t.startswith("t") for t in got) <= 1
    text = "".join(chr(97 + i // 1000) for i in range(20_000))
    assert set(labelled.spread(text, 16_384)) - {"\n"} == set(text) and labelled.spread("abc", 16_384) == "abc"


def test_toxicity(spark):
    mild = lambda r: " ".join(r.choice(WORDS) for _ in range(r.randint(20, 80)))
    rude = lambda r: mild(r) + " " + r.choice(["scoundrel", "Scoundrels"]) + " " + mild(r)
    rows, labels = labelled(spark, rude, mild)
    docs = docs_of(spark, rows)
    out = toxicity.score(docs, labels, "y").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([(r.predicted == 1) == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert toxicity.score(docs.where("false"), labels, "y").count() == 0


# ---------------------------------------------------------------- 7


def test_mixing(spark):
    rows = texts()
    docs = docs_of(spark, rows).unionByName(docs_of(spark, [(900, "a b c")]).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows) + 3
    for part, epochs in (((1, 2), 1), ((3, 1), 2), ((0, 1), 1)):
        out = mixing.mix(docs, domain_of(), WEIGHTS, part, epochs, 3)
        got = out.collect()
        used = sum(r._mix_tokens for r in got)
        limit = min(total * part[0] // part[1], total * epochs)
        longest = 30_000
        assert limit - 12 * longest <= used <= limit
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(0 <= r._mix_epoch < epochs for r in got)
    assert mixing.mix(docs.where("false"), domain_of(), WEIGHTS, (1, 2), 1, 3).count() == 0


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, {}, (400, 3010), 1).collect()}
    # 400 in all: 200 for each domain, 100 for each language of a; its first source can give 10 of its 50, its sibling the rest
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    zero = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, {"domain": {"b": 0}}, (400, 3010), 1).collect()}
    assert sum(zero.values()) == 400 and not any(d == "b" for d, _, _ in zero)


# ---------------------------------------------------------------- 9


def test_chain_prefers_the_diagonal():
    x, y = np.array([0, 5, 10, 15, 15]), np.array([0, 5, 10, 15, 90])
    assert chains.chain(x, y, 8.0, 0.2)[0].tolist() == [0, 1, 2, 3]
    assert chains.chain(np.array([0, 5]), np.array([5, 0]), 8.0, 0.2) == []


def test_passages(spark):
    rng = random.Random(6)
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    shared, rows = words(70), []
    rows.append((1, words(100) + shared + words(80)))
    rows.append((2, words(30) + shared + words(200)))
    fuzzy = list(shared)
    fuzzy[20] = "changed"
    del fuzzy[45]
    rows.append((3, words(60) + fuzzy + words(10)))
    rows.append((4, words(300)))
    rows.append((5, words(40) + shared[:30] + words(40)))
    rows = [(i, " ".join(w)) for i, w in rows] + [(6, rows[3][1] and " ".join(rows[3][1])), (7, None), (8, ""), (9, "a b"), (None, "x")]
    out = chains.passages(docs_of(spark, rows)).collect()
    got = {(r.doc_id, r.other_id): r for r in out}
    assert set(got) == {(2, 1), (3, 1), (6, 4)}
    assert (got[2, 1].start_word, got[2, 1].end_word, got[2, 1].other_start, got[2, 1].other_end) == (30, 100, 100, 170)
    assert (got[3, 1].start_word, got[3, 1].n_words, got[3, 1].equal_words) == (60, 69, 68)
    assert (got[6, 4].n_words, got[6, 4].equal_words) == (300, 300)
    assert chains.passages(docs_of(spark, rows).where("false")).count() == 0


def test_passages_of_copies_in_any_order(spark):
    rng = random.Random(9)
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(60)
    copied, other = " ".join(words(50) + shared + words(20)), " ".join(words(30) + shared + words(40))
    more = [(i, " ".join(words(5) + shared + words(15))) for i in range(40, 60)]  # a frequent passage, in some other window
    rows = [(30, copied), (20, copied), (5, other), (10, copied)]
    for docs in (rows, rows[::-1], [*rows, *more]):
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        for df in (df, df.repartition(3, F.col("doc_id") % 3)):
            got = {(r.doc_id, r.other_id) for r in chains.passages(df).collect()}
            assert {(10, 5), (20, 10), (30, 10)} <= got
            assert {d for d, _ in got} == {d for d, _ in docs} - {5}
    # the head is neither seeded first nor the smallest document of its frequent passage's first window
    docs = [(i, t) for i, t in [(30, copied), *more, (10, copied)]]
    got = {(r.doc_id, r.other_id) for r in chains.passages(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(30, 10), *((i, 10) for i, _ in more)}


def test_passages_whose_parts_have_older_homes(spark, monkeypatch):
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    first, second = words(60), words(60)
    rows = [(i, [*words(20), *first[8 * i : 8 * i + 20], *words(20)]) for i in range(6)]
    rows += [(10, [*words(30), *second[:34], *words(30)]), (11, [*words(30), *second[26:], *words(30)])]
    rows += [(100, [*words(10), *first, *words(30), *second]), (101, [*words(40), *first, *words(10)]), (102, [*words(5), *second, *words(9)])]
    for small, hot in ((24, 10**6), (24, 1), (1, 10**6)):
        monkeypatch.setattr(chains, "SMALL", small)
        monkeypatch.setattr(chains, "HOT", hot)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        for docs in (df.coalesce(1), df.repartition(3)):
            got = {(r.doc_id, r.other_id): (r.start_word, r.end_word) for r in chains.passages(docs).collect()}
            assert got == {(101, 100): (40, 100), (102, 100): (5, 65)}


def test_passages_with_changed_words(spark):
    """Of passages of 60 words that occur twice, with changed words at random: how many are found."""
    rng = random.Random(13)
    words = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    rows, kinds = [], {}
    for i in range(240):
        passage, changed = words(60), (0, 3, 6, 9)[i % 4]
        other = list(passage)
        for at in rng.sample(range(60), changed):
            other[at] = words(1)[0]
        rows += [(2 * i, " ".join(words(30) + passage + words(20))), (2 * i + 1, " ".join(words(15) + other + words(40)))]
        kinds[2 * i + 1] = changed
    got = {(r.doc_id, r.other_id) for r in chains.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(other == doc - 1 for doc, other in got)
    found = {n: sum((d, d - 1) in got for d, m in kinds.items() if m == n) / 60 for n in (0, 3, 6, 9)}
    assert found[0] == 1 and found[3] >= 0.95 and found[6] >= 0.9, found


# ---------------------------------------------------------------- 10


def brute_sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize(("k", "num", "den", "small"), [(4, 85, 100, 64), (2, 8, 10, 64), (1, 1, 2, 2)])
def test_jaccard(spark, monkeypatch, k, num, den, small):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = texts(seed=k)
    s = brute_sets(rows, k)
    pairs = [(a, b) for a in s for b in s if a < b and s[a] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    comp = union_find(pairs, s)
    docs = docs_of(spark, [*rows, (None, rows[0][1])])
    got = defaultdict(set)
    for r in jaccard.join(docs, k, num, den).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got.pop(None) == {(len(s[0]), None)}
    assert got == {i: {(len(s[i]), comp[i])} for i in s}
    left = jaccard.one_of_each(docs, k, num, den)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i in s if comp[i] == i)
    assert jaccard.join(docs.where("false"), k, num, den).count() == 0


def test_long_posting_lists_lose_nothing():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(30)]
    row = lambda i, s: (np.array([i], np.int64).tobytes(), np.array([len(s)], np.int32).tobytes(), np.array([len(s)], np.int32).tobytes(), s.tobytes())
    cols = list(zip(*(row(i, s) for i, s in enumerate(sets)), strict=True))
    t = pa.table(dict(zip(["names", "sizes", "counts", "hashes"], (pa.array(c, pa.binary()) for c in cols), strict=True)))
    whole = jaccard._bucket(t, 1, 2).to_pylist()
    assert {(r["a"], r["b"]) for r in whole if not r["long"]} == {(a, b) for a in range(30) for b in range(a + 1, 30) if 2 * min(len(sets[a]), len(sets[b])) >= max(len(sets[a]), len(sets[b])) and len(np.intersect1d(sets[a], sets[b]))}
    a, b = jaccard.Trie(sets, jaccard.Order(np.arange(10, dtype=np.uint64), np.arange(10, 20))).links(6, 10)
    want = union_find([(x, y) for x in range(30) for y in range(x) if 10 * len(np.intersect1d(sets[x], sets[y])) >= 6 * len(np.union1d(sets[x], sets[y]))], range(30))
    assert union_find(zip(a, b, strict=True), range(30)) == want


# ---------------------------------------------------------------- hashes


def thue_morse(n):
    """Two words of n letters whose sums of values times powers of any odd number are equal modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(1024)
    e = tokens.Encoder("word_bpe_49k.json")
    want = [t.ids for t in e.tok.encode_batch([x, y], add_special_tokens=False)]
    assert want[0] != want[1]
    for batch, ids in (([x, y], want), ([y], want[1:]), ([y, x, x], [want[1], want[0], want[0]])):
        got, many = e.encode(*utf8(pa.array(batch)))
        assert np.split(got, np.cumsum(many)[:-1]) and [g.tolist() for g in np.split(got, np.cumsum(many)[:-1])] == ids
    rows = [(1, x), (2, y), (3, x)]
    got = {r.doc_id: r.ids_crc32 for r in wavelet.round_trip(docs_of(spark, rows), "word_bpe_49k.json", 2).collect()}
    assert got == {i: crc(ids) for i, ids in ids_of("word_bpe_49k.json", rows, 2)}
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(docs_of(spark, rows), "byte_bpe_50k.json").collect()}
    assert got == {i: crc(ids) for i, ids in ids_of("byte_bpe_50k.json", rows, 0)}
    assert {r.doc_id: r.component_id for r in jaccard.join(docs_of(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    """Even if all chunks of one length had the same hash."""
    monkeypatch.setattr(tokens, "segment_hashes", lambda raw, starts, lens: lens.astype(np.uint64))
    e = tokens.Encoder("byte_bpe_50k.json")
    for batch in (["one two six"], ["ten"], ["two one"], ["", "ten one"]):
        ids, many = e.encode(*utf8(pa.array(batch)))
        assert ids.tolist() == [i for t in e.tok.encode_batch(batch, add_special_tokens=False) for i in t.ids] and len(many) == len(batch)
