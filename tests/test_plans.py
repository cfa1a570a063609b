"""Order within hot groups, joins by hot keys, and the operators that stand on them, against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidence_engine.functions.text import jaccard
from evidence_engine.operators import articles as A
from evidence_engine.operators import claims, cluster
from evidence_engine.operators import events as E
from evidence_engine.operators import search as S
from evidence_engine.operators import windows as W
from evidence_engine.params import Params
from evidence_engine.plans import pairs as P
from evidence_engine.plans.ordered import SALTS, first_per_key, neighbours

NOW = dt.datetime(2024, 1, 31)
PLAIN = Params(stop_words=[], canonical={})


def tasks_with_rows(df):
    """Rows in each partition of a plan's result."""
    return [n for n in df.groupBy(F.spark_partition_id()).count().toPandas()["count"] if n]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_neighbours_in_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice("aaaab"), at, rng.random() < 0.3) for at in rng.sample(range(1000), 400)] + [("c", 1, False), ("d", 1, True)]
    table = spark.createDataFrame(rows, "g string, at int, member boolean")
    got = {(r.g, r.at): (r.before, r.after) for r in neighbours(table, "g", "at", "member", ranges).collect()}
    for g, at, _ in rows:
        members = [x for h, x, m in rows if h == g and m and x != at]
        assert got[g, at] == (max((x for x in members if x < at), default=None), min((x for x in members if x > at), default=None))
    assert len(got) == len(rows)


def test_first_per_key_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randint(0, 50), i) for i in range(5000)] + [(f"k{i % 40}", i % 7, i) for i in range(120)]
    table = spark.createDataFrame(rows, "k string, v int, i int")
    got = sorted((r.k, r.place, r.i) for r in first_per_key(table, ["k"], ["v", "i"], 16, F.col("i")).collect())
    want = []
    for k in {r[0] for r in rows}:
        want += [(k, n + 1, i) for n, (_, i) in enumerate(sorted((v, i) for x, v, i in rows if x == k)[:16])]
    assert got == sorted(want)
    plan = first_per_key(table, ["k"], ["v", "i"], 16, F.col("i"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and SALTS * 16 < 5000


def test_event_sources_of_a_hot_cluster(spark):
    rows = [("hot" if i % 10 else f"c{i}", i, f"u{i}", NOW - dt.timedelta(minutes=i * 7919 % 5000), "public-conversation" if i % 3 == 0 else "news") for i in range(3000)]
    members = spark.createDataFrame(rows, "cluster_id string, ord int, url string, published_at timestamp, channel string")
    got = {r.cluster_id: r.sources for r in W.event_sources(members, members.select("ord", (F.col("ord") % 4).alias("tier"))).collect()}
    order = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[4] == "public-conversation", r[1] % 4, -r[3].timestamp(), r[1]))
    assert got["hot"] == " ".join(r[2] for r in order[:16]) and len(got) == 301


def test_meet_deals_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [("cold", -1), ("left", 1)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(70)] + [("cold", -2), ("right", 1)], "k string, b int")
    met = P.meet(left, right, ["k"], F.col("a"), F.col("b"), block=50)
    assert met.columns == ["k", "a", "b"] and met.count() == 900 * 70 + 1 == met.distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert max(tasks_with_rows(P.meet(left, right, ["k"], F.col("a"), F.col("b"), block=50))) < 900 * 70 / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def by_greedy(order, related):
    groups = []
    for i in range(len(order)):
        for g in groups:
            if any(related(i, j) for j in g):
                g.append(i)
                break
        else:
            groups.append([i])
    return {order[i]: order[g[0]] for g in groups for i in g}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_clusters_with_copies_are_those_of_the_greedy_loop(spark, seed):
    """Groups of many copies beside each other: the edges that are left out change nothing."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(9)]
    kinds = [" ".join(sorted(rng.sample(words, rng.randint(2, 5)))) for _ in range(14)]
    rows = [(i, rng.choice(kinds[:3] if rng.random() < 0.6 else kinds), NOW - dt.timedelta(hours=rng.randint(0, 40)), "news") for i in range(150)]
    table = spark.createDataFrame(rows, "ord long, title string, published_at timestamp, channel string")
    groups = cluster.title_groups(table, spark.createDataFrame([], "ord long, entity_id string"), PLAIN)
    got = {r.ord: r.cluster_id for r in cluster.cluster_articles(table, groups, cluster.related_pairs(groups)).collect()}
    order = sorted(rows, key=lambda r: (-r[2].timestamp(), r[0]))
    sets = [set(r[1].split()) for r in order]
    assert got == by_greedy([r[0] for r in order], lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.64)


def test_edges_of_a_hot_group_are_linear(spark):
    copies, others = 100_000, 30
    table = spark.range(copies + others).select(
        F.col("id").alias("ord"), F.when(F.col("id") < copies, "one two three four five").otherwise(F.concat(F.lit("one two three four five x"), F.col("id").cast("string"))).alias("title"),
        F.expr("timestampadd(SECOND, -CAST(id * 7919 % 100000 AS INT), TIMESTAMP '2024-01-31')").alias("published_at"), F.lit("news").alias("channel"),
    )
    groups = cluster.title_groups(table, spark.createDataFrame([], "ord long, entity_id string"), PLAIN)
    pairs = cluster.related_pairs(groups)
    assert pairs.count() == others * (others + 1) / 2
    edges = cluster._edges(table, groups, pairs)
    # one for each article, and two for each article of a pair's smaller group; every article and every pair would give 3 000 000
    assert edges.count() <= copies + others + 2 * others * (others + 1) / 2
    labels = cluster.cluster_articles(table, groups, pairs)
    assert labels.select("cluster_id").distinct().count() == 1


def test_candidates_are_fewer_and_lose_no_pair(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["2024", "7"]
    rows = [(f"g{i}", sorted(rng.sample(words[:25] if i % 2 else words, rng.randint(1, 7))), i % 5 == 0, [f"e{x}" for x in rng.sample(range(6), rng.randint(0, 2))]) for i in range(300)]
    rows = list({tuple(r[1]): r for r in rows}.values())
    table = spark.createDataFrame(rows, "group_id string, tokens array<string>, public boolean, entity_ids array<string>")
    met = {(r.a, r.b) for r in cluster.candidates(table).collect()}
    want, loose = set(), 0
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                common = set(x[1]) & set(y[1])
                n, sim = len(common), len(common) / len(set(x[1]) | set(y[1]))
                digit, public, entity = any(c[0].isdigit() for c in common), x[2] or y[2], bool(set(x[3]) & set(y[3]))
                rule = (n >= 5 and sim >= 0.48) or (n >= 4 and sim >= 0.42 and digit) if public else (n >= 4 and sim >= 0.42) or (n >= 3 and sim >= 0.34 and digit)
                loose += n > 0 and min(len(x[1]), len(y[1])) >= 0.34 * max(len(x[1]), len(y[1]))
                if sim >= (0.72 if public else 0.64) or (entity and rule):
                    want.add((x[0], y[0]))
    assert want <= met and len(met) < loose / 2
    assert {(r.a, r.b) for r in cluster.related_pairs(table).collect()} == want
    P.BLOCK, old = 4, P.BLOCK
    try:
        assert {(r.a, r.b) for r in cluster.related_pairs(table).collect()} == want
    finally:
        P.BLOCK = old


@pytest.mark.parametrize("block", [3, P.BLOCK])
def test_contradictions_of_a_hot_scope(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(6)
    words = [f"word{i}" for i in range(12)]
    facts = [(f"c{i:03}", "hot" if i % 4 else f"s{i % 3}", " ".join(rng.sample(words, rng.randint(1, 6)) + (["not"] if rng.random() < 0.4 else []))) for i in range(160)]
    got = {(r.a, r.b) for r in claims.contradictions(spark.createDataFrame(facts, "claim_id string, scope string, text string")).collect()}
    first = {}
    for i, scope, text in facts:
        key = scope, frozenset(text.split()) - {"not"}, "not" in text.split()
        first[key] = min(first.get(key, i), i)
    nodes = [(i, *k) for k, i in first.items()]
    want = {tuple(sorted((x[0], y[0]))) for x in nodes for y in nodes if x[1] == y[1] and x[3] != y[3] and len(x[2] & y[2]) / min(len(x[2]), len(y[2])) >= claims.OVERLAP}
    assert got == want and len(want) > 20


ENTITIES = "entity_id string, name string, type string, tier int, parent_id string, ambiguous boolean, aliases array<string>, context array<string>"


@pytest.mark.parametrize("rows", [0, A.BROADCAST_ROWS])
def test_entities_by_their_rarest_word(spark, monkeypatch, rows):
    monkeypatch.setattr(A, "BROADCAST_ROWS", rows)
    entities = spark.createDataFrame(
        [("a", "Bank of the West", "company", 0, None, False, ["West Bank", "B.O.W."], []), ("b", "The Bank", "company", 1, None, False, [], []), ("c", "Coca-Cola", "brand", 1, None, False, ["coca cola zero"], []), ("d", "...", "brand", 1, None, False, [], [])], ENTITIES
    )
    docs = spark.createDataFrame(
        [(1, "the bank of the west, today"), (2, "West-Bank and west bank"), (3, "coca cola; coca-cola"), (4, "coca cola zero sugar"), (5, "embankment"), (6, "b.o.w. and the bankers"), (7, None), (8, "")], "ord long, text string"
    )
    got = sorted((r.ord, r.entity_id, r.matched_alias) for r in A.match_entities(docs, entities, PLAIN).collect())
    assert got == [(1, "a", "bank of the west"), (1, "b", "the bank"), (2, "a", "west bank"), (3, "c", "coca-cola"), (4, "c", "coca cola zero"), (6, "a", "b.o.w.")]
    index = {r.alias: r.word for r in A.alias_index(entities, PLAIN).collect()}
    assert index["bank of the west"] == "of" or index["bank of the west"] in ("west", "of")
    part = docs.withColumn("part", F.substring("text", 1, 9))
    assert {(r.ord, r.alias): r.in_part for r in A.entity_hits(part, entities, PLAIN).collect()}[2, "west bank"] is False


@pytest.mark.parametrize("rows", [0, A.BROADCAST_ROWS])
def test_containing_by_rarest_run(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(P, "BLOCK", 3)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab c₹", k=rng.randint(0, 30))) for _ in range(80)] + ["", "aaaa" * 2000, "aab" * 10]
    asked = ["", "a", "ab", "aab", "₹a", "abca", "aaaaaaa", "b c", "zzz", "a" * 8001, None, ""]
    told = spark.createDataFrame(list(enumerate(texts)), "event_id int, body string")
    got = {(r.qid, r.event_id) for r in S.containing(told, spark.createDataFrame(list(enumerate(asked)), "qid int, q string")).collect()}
    assert got == {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if q is not None and q in t}


def test_jaccard_of_empty_sets(spark):
    row = spark.sql("SELECT array() AS a, array('x') AS b").select(jaccard(F.col("a"), F.col("b")).alias("j"))
    assert row.first().j == 0


def test_events_do_not_depend_on_where_texts_are_judged(spark):
    rows = [(f"c{i % 3}", i, f"title {i} launches", "body text " * (i % 4) + "regulator", f"https://x{i}.example.com/a", f"x{i % 5}.example.com", NOW - dt.timedelta(hours=i), "news" if i % 4 else "public-conversation", i % 6 == 0, i) for i in range(24)]
    members = spark.createDataFrame(rows, "cluster_id string, ord int, title string, description string, url string, host string, published_at timestamp, channel string, official boolean, engagement int")
    matches = members.select("ord", F.lit("e").alias("entity_id"), F.lit("company").alias("type"), F.lit(1).alias("tier"))
    tiers = members.select("ord", (F.col("ord") % 4).alias("tier"))
    entities = spark.createDataFrame([("e", "Example", 0)], "entity_id string, name string, position int")
    now = F.lit(NOW)
    whole = E.derive_events(members, matches, tiers, entities, now)
    apart = E.derive_events(E.event_features(members), matches, tiers, entities, now, texts=members.select("ord", "description"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect())) and whole.count() == 3


@pytest.mark.parametrize("ranges", [1, 4])
def test_ranks_across_ranges(spark, ranges):
    from evidence_engine.plans.ordered import ranks

    rng = random.Random(7)
    rows = [("hot" if i % 5 else rng.choice("ab"), rng.randint(0, 9), i) for i in range(300)] + [(None, 1, 1000), (None, 0, 1001)]
    got = {r.i: r.place for r in ranks(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), "i"], ranges=ranges).collect()}
    for k in {r[0] for r in rows}:
        order = sorted((-v, i) for x, v, i in rows if x == k)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    assert len(got) == len(rows)


def test_a_long_way_to_the_first_article(spark):
    """Each of a chain of articles is related to the one before it and to one of its own, newer than all of the chain: the newest one's label goes the whole way."""
    n = 60
    rows = [(i, NOW - dt.timedelta(minutes=i)) for i in range(2 * n)]
    table = spark.createDataFrame(rows, "ord long, published_at timestamp")
    groups = table.select("ord", F.col("ord").cast("string").alias("group_id"), F.array(F.lit("x")).alias("tokens"))
    pairs = [(str(i), str(n + i)) for i in range(n)] + [(str(n + i - 1), str(n + i)) for i in range(1, n)]
    got = {r.ord: r.cluster_id for r in cluster.cluster_articles(table, groups, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {i: i for i in range(n)} | {n + i: 0 for i in range(n)}
