"""The registered queries of operators 2 to 8 on whole tables, against brute force, exact round trips or held-out labels."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pytest
import xxhash

from evidence_engine.llm import secrets_cnn, spotsigs
from evidence_engine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def chained(words: list[str]) -> str:
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return f"{h:016x}"


def signature_set(text: str) -> set:
    words = re.findall(r"[^\W_]+", text.lower())
    content = [w for w in words if w not in spotsigs.ANCHORS]
    found, before = set(), 0
    for w in words:
        if w not in spotsigs.ANCHORS:
            before += 1
        elif len(content[before : before + 2]) == 2:
            found.add(chained([w, *content[before : before + 2]]))
    return found or {chained(words[i : i + 3]) for i in range(len(words) - 2)}


def test_op2(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in QUERIES["op2_spotsigs"](spark, SF).collect()}
    assert sorted(got) == ids
    for n, i in enumerate(ids):
        own, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == sha(edited)
        if len(re.findall(r"[^\W_]+", own)) > 2 and len(re.findall(r"[^\W_]+", edited)) > 2 and len(re.findall(r"[^\W_]+", after)) > 2:
            a, b, c = map(signature_set, (own, edited, after))
            assert set(got[i].fingerprint.split(",")) == a and set(got[i].edited_fingerprint.split(",")) == b
            assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b)) and got[i].near_next == pytest.approx(len(a & c) / len(a | c))


def test_op3(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[ \t\n\v\f\r]+", t.lower()) if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    least = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = {k: min(a, b) if c in (a, b) else c for k, c in least.items()}
    assert {r.doc_id: r.class_id for r in QUERIES["op3_probminhash"](spark, SF).collect()} == least


def test_op4_held_out(spark):
    rows = QUERIES["op4_langid_ecoc"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98


def test_op5(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op5_secrets_cnn"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        base = [(m.start(), 0, m.end()) for m in re.finditer(secrets_cnn.ASSIGN, t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = ",".join(f"{secrets_cnn.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert got[i].base_sha256 == sha(spans) and set(filter(None, spans.split(","))) <= set(got[i].spans.split(","))
        model = [s.split(":") for s in got[i].spans.split(",") if s.startswith("model")]
        assert all(re.search("[A-Za-z]", t[int(a) : int(b)]) for _, a, b in model)


def test_op6_held_out(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality")
    every = QUERIES["op6_quality_pu"](spark, LARGER)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in every.collect())
    held = every.filter("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.95


def test_op7(spark, texts):
    first: dict = {}
    for i in sorted(texts):
        body = texts[i].encode()
        for k in range(len(body) - 49):
            first.setdefault(body[k : k + 50], i)
    got = {r.doc_id: r for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()}
    for i, t in texts.items():
        body = t.encode()
        gone = bytearray(len(body))
        for k in range(len(body) - 49):
            if first[body[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(body), sum(gone), runs, sha(kept))


def test_op8(spark, texts):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op8_byte_bpe"](spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        ids = reference.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t))
