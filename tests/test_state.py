"""Tables in buckets, streams with state and fingerprints that follow changes, against the batch and the whole."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import claims
from evidence_engine.plans import buckets
from evidence_engine.plans.buckets import manifest, read_table, upsert, vacuum
from evidence_engine.plans.merge import merge_table
from evidence_engine.streaming import streams

NOW = dt.datetime(2024, 1, 31)
ROW = "k long, v long, first string"


def rows(spark, *items):
    return spark.createDataFrame(list(items), ROW)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_buckets_write_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert content(read_table(spark, path, ROW)) == [] and manifest(spark, path) is None
    whole = rows(spark, *[(i, i, "a") for i in range(200)])
    assert upsert(path, whole, 0, ["k"], buckets=16, insert_only=["first"]) == set(range(16))
    before = manifest(spark, path)[2]
    change = rows(spark, (3, 30, "b"), (500, 1, "b"), (None, 9, "b"))
    touched = upsert(path, change, 1, ["k"], insert_only=["first"])
    after = manifest(spark, path)[2]
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == touched
    assert content(read_table(spark, path, ROW).na.fill(-1)) == content(merge_table(whole, change, ["k"], insert_only=["first"]).na.fill(-1))
    # a batch that comes again changes nothing, nor does an older one; an empty batch moves the manifest on
    assert upsert(path, rows(spark, (3, 99, "c")), 1, ["k"]) == set() == upsert(path, rows(spark, (3, 99, "c")), 0, ["k"])
    assert upsert(path, rows(spark).filter("false"), 2, ["k"]) == set() and manifest(spark, path)[0] == 2
    assert content(read_table(spark, path, ROW).filter("k = 3")) == [(3, 30, "a")]


def test_a_crash_between_buckets_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert(path, rows(spark, (1, 1, "a"), (2, 2, "a")), 0, ["k"], buckets=4)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "commit", crash)
        with pytest.raises(OSError):
            upsert(path, rows(spark, (1, 10, "b")), 1, ["k"])
    assert content(read_table(spark, path, ROW)) == [(1, 1, "a"), (2, 2, "a")] and len(os.listdir(f"{path}/data")) == 2
    upsert(path, rows(spark, (1, 10, "b")), 1, ["k"])
    assert content(read_table(spark, path, ROW)) == [(1, 10, "b"), (2, 2, "a")]
    assert vacuum(spark, path, keep=1) == 1 and content(read_table(spark, path, ROW)) == [(1, 10, "b"), (2, 2, "a")]


def test_stream_upserts_equal_one_merge(spark, tmp_path):
    rng = random.Random(1)
    items = [(rng.randint(0, 40), i, "x") for i in range(120)]
    for part in range(4):
        rows(spark, *items[part * 30 : part * 30 + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.table_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    run = streams.upsert_batches(str(tmp_path / "t"), ["k"], buckets=8)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for k, v, x in items:
        last[k] = v
    got = {r.k: r.v for r in read_table(spark, str(tmp_path / "t"), ROW).collect()}
    assert got == last


@pytest.mark.parametrize("seed", [1, 2])
def test_visits_are_events_of_their_own(spark, tmp_path, seed):
    """Whatever batches visits and events come in, the stream tells what the batch query tells."""
    rng = random.Random(seed)
    events = [(u, u * 1000 + i, NOW + dt.timedelta(minutes=rng.randint(0, 3000))) for u in range(6) for i in range(25)]
    visits = [(u, NOW + dt.timedelta(minutes=rng.randint(0, 3000))) for u in range(5) for _ in range(rng.randint(0, 5))] + [(5, events[-1][2])]
    rng.shuffle(events)
    far = NOW + dt.timedelta(days=400)
    for n in range(4):
        spark.createDataFrame(events[n::4], "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        spark.createDataFrame(visits[n::4] or [(-2, NOW)], "user_id long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    spark.createDataFrame([(-1, -1, far)], "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    spark.createDataFrame([(-1, far)], "user_id long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    e, v = (streams.table_stream(spark, str(tmp_path / x), files_per_batch=1) for x in "ev")
    got = streams.drain(streams.stream_new_since_visit(e, v, "30 days"), str(tmp_path / "run")).filter("user_id >= 0")
    want = streams.new_since_visit(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "v"))).filter("user_id >= 0")
    assert content(got) == content(want)
    by_hand = sorted((u, i, t, min(x for w, x in visits if w == u and x >= t)) for u, i, t in events if any(w == u and x >= t for w, x in visits))
    assert content(want) == by_hand and len(by_hand) > 40


def test_spans_from_panes(spark, tmp_path):
    rng = random.Random(3)
    items = [(rng.choice("ab"), NOW + dt.timedelta(minutes=rng.randint(0, 6000))) for _ in range(200)]
    table = spark.createDataFrame(items, "key string, ts timestamp").repartition(3)
    table.write.parquet(str(tmp_path / "in"))
    panes = streams.drain(streams.stream_panes(streams.table_stream(spark, str(tmp_path / "in"), 1).withWatermark("ts", "10 days"), "ts", "key"), str(tmp_path / "run"), "complete")
    hour = lambda t: t.replace(minute=0, second=0, microsecond=0)
    for r in streams.momentum_spans(panes, "key").collect():
        for h in streams.SPANS:
            assert r[f"n{h}"] == sum(k == r.key and dt.timedelta(0) <= r.pane - hour(t) < dt.timedelta(hours=h) for k, t in items)


def test_fingerprints_follow_changes(spark):
    table = spark.createDataFrame([(i, f"t{i % 7}", None if i % 5 else 1.5) for i in range(60)], "i int, t string, x double")
    part, more = table.filter("i < 40"), spark.createDataFrame([(100, "new", 2.0), (100, "new", 2.0)], table.schema)

    def told(df):
        return df.select("rows", claims.fingerprint_text().alias("text")).first()

    def of(df):
        return claims.content_fingerprint(df, ["i", "t", "x"])

    changed = claims.changed_fingerprint(of(table), of(table.filter("i >= 40")), of(more))
    assert told(changed) == told(of(part.union(more).repartition(5))) and changed.first().rows == 42
    assert told(of(part.union(more))) != told(of(part.union(more.distinct()))) and len(of(table).first().lanes) == claims.LANES
    assert told(of(table.filter("false"))).rows == 0
    assert told(claims.changed_fingerprint(of(table), of(table), of(table.filter("false")))) == told(of(table.filter("false")))


def test_conversations_meet_over_the_borders_of_panes(spark, tmp_path):
    """One token for all, times on the borders too: each pair within the span comes once, and many tasks find them."""
    rng = random.Random(5)
    day = dt.timedelta(days=1)
    times = [dt.datetime(2024, 1, 5) + day * k + dt.timedelta(microseconds=x) for k in range(6) for x in (-1, 0, 1)] + [dt.datetime(2024, 1, 5) + dt.timedelta(minutes=rng.randint(0, 9000)) for _ in range(40)]
    media, public = list(enumerate(times)), [(100 + i, t) for i, t in enumerate(times)]
    spark.createDataFrame([(i, "x", t) for i, t in media], "ord long, token string, published_at timestamp").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([(i, "x", t) for i, t in public], "item long, token string, said_at timestamp").write.parquet(str(tmp_path / "p"))
    pairs = streams.stream_conversation_attach(streams.table_stream(spark, str(tmp_path / "m")), streams.table_stream(spark, str(tmp_path / "p")))
    got = streams.drain(pairs, str(tmp_path / "run"))
    assert content(got.select("ord", "item")) == sorted((i, k) for i, s in media for k, t in public if abs(s - t) <= day)
    assert got.select(F.input_file_name()).distinct().count() > 2
