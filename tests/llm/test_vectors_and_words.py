"""Operators 11 to 13: clustering, hard negatives and speculative BPE, against brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_engine.llm import centroids as C
from evidence_engine.llm import hard_negatives as H
from evidence_engine.llm import speculative_bpe as S
from evidence_engine.llm import words
from evidence_engine.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, `cluster` string, `key` string, `id` string, `list` string, mark string"


def table(spark, rows):
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def usable(v, width=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (width is None or len(v) == width)


def floors(v, scale):
    return [math.floor(x * scale) if abs(x) < 2**50 else int(x) * scale for x in v]


def kmeans(rows, k, rounds, width):
    kept = [(i, floors(v, 1024)) for i, v, *_ in rows if usable(v, width)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, x) in zip(kept, of, strict=True) if x == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    inertia = [sum(d for d, x in of if x == j) for j in range(len(centers))]
    most = 2**63 - 1
    return sorted((str(i), j, min(d, most), min(inertia[j], most), min(sum(min(x, most) for x in inertia), most), ",".join(map(str, centers[j]))) for (i, _), (d, j) in zip(kept, of, strict=True))


def clustered(df, **kw):
    rows = C.cluster(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    return sorted((str(r[0]), *r[1:]) for r in rows.collect())


def test_centroids(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(i % 5, 0.2) for _ in range(4)], 0) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 1.0], 1) for i in range(150)]  # copies of one vector
    rows += [(7, [9.0, 9, 9, 9], 1), (7, [9.0, 9, 9, 9], 1), (None, [1.0, 1, 1, 1], 1)]
    rows += [(2000, None, 1), (2001, [1.0, 2, 3], 1), (2002, [1.0, None, 2, 3], 1), (2003, [1.0, math.nan, 2, 3], 1), (2004, [1.0, math.inf, 2, 3], 1), (2005, [], None)]
    for k, rounds in ((5, 4), (1, 1), (3, 0)):
        assert clustered(table(spark, rows), k=k, rounds=rounds, width=4) == kmeans(rows, k, rounds, 4)


def test_centroids_without_vectors_and_with_few(spark):
    assert clustered(table(spark, [(1, None, 1)]), width=4) == []
    assert C.cluster(table(spark, []).filter("false"), width=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    few = [(i, [float(i), 0.0], 0) for i in range(3)]
    assert clustered(table(spark, few), width=2, rounds=2) == kmeans(few, 8, 2, 2)


def test_centroids_of_huge_components_are_exact(spark):
    rows = [(i, [float(i % 3), 1e5 * (i % 2), 3e15], 0) for i in range(20)] + [(50, [-3e38, 0.0, 1.0], 0), (51, [1.0, 2.0, 3.0], 0), (52, [1.0, 2.5, 3.0], 0)]
    assert clustered(table(spark, rows), k=4, rounds=3, width=3) == kmeans(rows, 4, 3, 3)


def test_simplex_bounds_hold_and_leave_centroids_out():
    rnd = np.random.default_rng(1)
    sample = np.concatenate([rnd.normal(c, 30, (60, 16)) for c in (0, 400, -900, 2000)]).astype(np.int64)
    base = C.simplex(sample)
    rows, at = sample[::2], base.project(sample[::2])
    for other in sample[1::17]:
        apex = base.project(other[None])[0]
        true = ((rows - other) ** 2).sum(1)
        flat = ((at[:, 1:-1] - apex[1:-1]) ** 2).sum(1)
        slack = C.SLACK * (at[:, 0] + apex[0]) + 1e-6
        assert (flat + (at[:, -1] - apex[-1]) ** 2 <= true + slack).all() and (flat + (at[:, -1] + apex[-1]) ** 2 >= true - slack).all()
    centers = C.Centroids.of(sample[[3, 63, 123, 183]].tolist(), base, 1 << 20)
    left = C.candidates(at, centers)
    assert left.sum() < 1.2 * len(rows)  # nearly always one of four
    assert len(C.simplex(np.zeros((5, 3), np.int64)).pivots) == 1 and C.simplex(np.zeros((0, 3), np.int64)).project(np.zeros((2, 3), np.int64)).shape == (2, 1)


def test_limbs():
    for sums in ([0, -1, 5], [2**31, -(2**31) - 1, 7], [2**140, -(2**139), 3]):
        parts = C.limbs(sums)
        assert [sum(p[i] << 32 * n for n, p in enumerate(parts)) for i in range(3)] == sums


def mined_by_hand(rows, scale=256, positives=5, negatives=10, low=30, high=90):
    most = 2**63 - 1
    kept = [(i if i is not None else most, label, floors(v, scale)) for i, v, label in rows if label is not None and usable(v)]
    out = []
    seen = set()
    for i, label, v in kept:
        if i == most or i % 100 or (i, label, tuple(v)) in seen:
            continue
        seen.add((i, label, tuple(v)))
        scored = [(max(-most - 1, min(most, sum(a * b for a, b in zip(v, w, strict=False)))), j, m) for j, m, w in kept]
        own = sorted(((-s, j) for s, j, m in scored if m == label and j != i))[:positives]
        for p, pid in own:
            p = -p
            found = sorted((-s, j) for s, j, m in scored if m != label and low * p <= 100 * s <= high * p)[:negatives]
            out += [(i, pid if pid != most else None, n + 1, j if j != most else None, p, -s) for n, (s, j) in enumerate(found)]
    return sorted(map(str, out))


def mined(df, **kw):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in H.mine(df, F.col("vec_id") % 100 == 0, **kw).select(*names).collect())


@pytest.mark.parametrize("anchors", [2, H.ANCHORS])
def test_hard_negatives(spark, monkeypatch, anchors):
    monkeypatch.setattr(H, "ANCHORS", anchors)
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(i % 3, 0.5) for _ in range(20)], i % 4) for i in range(0, 900, 3)]
    rows += [(5000 + i, [1.0] * 20, i % 4) for i in range(120)]  # copies of one vector: ties
    rows += [(300, [0.5] * 20, 1), (300, [0.5] * 20, 1), (600, [0.25] * 20, 2), (None, [1.5] * 20, 1), (None, [1.5] * 20, 0)]
    rows += [(7001, [2.0] * 5, 1), (7002, [], 2), (7003, None, 1), (7004, [1.0], None), (7100, [math.nan] * 20, 1), (7200, [None] * 20, 1)]
    got = mined(table(spark, rows))
    assert got == mined_by_hand(rows) and len(got) > 100


def test_hard_negatives_of_huge_components_and_empty_tables(spark):
    rows = [(i, [1e18 * (i % 3), 1.0, float(i)], i % 2) for i in range(0, 60, 5)] + [(100, [3e38, 1.0, 1.0], 0), (200, [0.5, 1.0, -1.0], 1), (201, [3e38, 1.0, 2.0], 1)]
    assert mined(table(spark, rows)) == mined_by_hand(rows)
    assert mined(table(spark, [])) == [] == mined(table(spark, [(1, [1.0], 1)])) == mined(table(spark, [(100, None, 1)]))


def test_segment_bounds_leave_pairs_out(spark):
    rnd = np.random.default_rng(2)
    values = np.concatenate([np.tile(rnd.normal(0, 200, (8, 4, 1)), (1, 1, 8)).reshape(8, 32).repeat(40, axis=0) + rnd.normal(0, 5, (320, 32))]).astype(np.int64)
    rows = pa.table({"id": np.arange(320), "label": [0] * 320, "ints": [v.astype("<i4").tobytes() for v in values], "wide": pa.nulls(320, pa.string()), "summary": [s.tobytes() for s in H.summaries(values.astype(float)).astype("<f4")]})
    block = H.Block.of(rows.to_batches()[0], pa.array([0]), 32)
    every, some = np.arange(320), np.arange(10)
    exact = values @ values[:10].T
    low, high = np.full(10, 0.5 * (values**2).sum(1).mean()), np.full(10, 1e12)
    for share in (0.0, 0.5, 2.0):  # all ways to judge a block
        H.DENSE, old = share, H.DENSE
        i, j, score = H.left_over(block, every, block, some, low, high, None)
        H.DENSE = old
        ok = score >= low[j]
        assert set(zip(i[ok].tolist(), j[ok].tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(exact >= low)), strict=True))
        assert (score == exact[i, j]).all() and len(i) < exact.size / 2


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def same_as(library, path, texts):
    encoder = S.encoder(path)
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert S.decoded(encoder.vocabulary, ids, at).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]


def test_speculative_bpe(library, path):
    rnd = random.Random(1)
    letters = [*"aabest'' \n\t.,12<|>rvlmdé Ж漢😀́\r\x1c\x85", "'s", "'ll", " the", "<|endoftext|>", " "]
    same_as(library, path, ["", None, "a  b", "   ", "'s's 's ''s 'stuff I'LL", "x<|endoftext|> y's<|endoftext|><|endoftext|>  z", " <|endoftext|> "])
    for _ in range(10):
        same_as(library, path, ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(500)])
    for _ in range(5):
        same_as(library, path, ["".join(chr(c) for c in (rnd.randint(0, 0x10FFFF) for _ in range(80)) if not 0xD800 <= c < 0xE000) for _ in range(100)])


def test_speculative_bpe_of_every_character(library, path):
    texts = [f"a{c}1{c}! {c}" for c in (chr(n) for n in range(0x30000) if not 0xD800 <= n < 0xE000)]
    same_as(library, path, texts)


def test_speculative_bpe_long_texts(library, path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 1000)
    same_as(library, path, ["wordless" * 3000 + "  end", "x'll  y " * 4000 + "<|endoftext|>" + "some words " * 500, "aaaa" * 5000])


def test_speculative_bpe_of_colliding_hashes(library, path, monkeypatch):
    monkeypatch.setattr(words, "span_hashes", lambda body, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    same_as(library, path, ["the cat sat on the mat, the dog did not", "a b c d e f ab cd ef abc"])


def test_speculation_fails_on_some_words_and_merging_agrees(library, path):
    vocabulary = S.encoder(path).vocabulary
    words = sorted({w for n in range(1, 400) for w in (f" {n * 7919:x}thing".encode(), f"anonymouslyre{n}".encode())})
    ids, failed = vocabulary.encode_words(words)
    assert 0 < failed < len(words)
    for w, told in zip(words, ids, strict=True):
        assert np.frombuffer(told, "<u4").tolist() == vocabulary.merged(w)


def test_op13(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op13_speculative_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_speculative_bpe_rows(spark, path):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "z")], "doc_id int, text string, ids string")
    rows = S.decode(S.encode(docs, path), path).collect()
    assert sorted((str(r.doc_id), len(r.ids), r.body) for r in rows) == [("1", 8, "a b"), ("1", 8, "a b"), ("None", 0, "")]
    assert S.encode(docs.filter("false"), path).count() == 0
    broken = spark.createDataFrame([(1, np.array([S.encoder(path).vocabulary.byte[0xE6], 10**6], "<u4").tobytes())], "doc_id int, ids binary")
    assert [r.body for r in S.decode(broken, path).collect()] == ["�"]
