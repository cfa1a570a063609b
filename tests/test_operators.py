"""Operators on literal rows and random data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidence_engine import fixtures as X
from evidence_engine.operators import articles as A, registry
from evidence_engine.operators import audits, claims, cluster
from evidence_engine.operators import events as E
from evidence_engine.params import Params
from evidence_engine.plans.merge import merge_table
from evidence_engine.sources import feeds
from evidence_engine.streaming import streams

NOW = dt.datetime(2024, 1, 31)
ENTITIES = "entity_id string, name string, type string, tier int, parent_id string, ambiguous boolean, aliases array<string>, context array<string>"


def test_entity_context_rules(spark):
    entities = spark.createDataFrame(
        [("g", "Acmet Group", "group", 0, None, False, ["Acmet"], []), ("m", "Idea", "brand", 1, "g", False, [], []), ("p", "Ann Lee", "person", 0, "g", True, [], []), ("r", "Central Bank", "stakeholder", 2, None, False, ["RBI"], ["rate"])], ENTITIES
    )
    docs = spark.createDataFrame(
        [(1, "A good idea for all"), (2, "Acmet launches Idea network"), (3, "Ann Lee wins a race"), (4, "Acmet Group names Ann Lee"), (5, "Central Bank holds"), (6, "Central Bank fines Acmet"), (7, "Acmetville opens")], "ord long, text string"
    )
    got = {(r.ord, r.entity_id): r.matched_alias for r in A.match_entities(docs, entities, Params()).collect()}
    assert got == {(2, "g"): "acmet", (2, "m"): "idea", (4, "g"): "acmet group", (4, "p"): "ann lee", (6, "g"): "acmet", (6, "r"): "central bank"}


def test_registry_order_decides_the_tier(spark):
    rows = spark.createDataFrame([("news.example.com",), ("www.example.com",), ("example.org",), ("notexample.com",), (None,)], "host string")
    registry = spark.createDataFrame([(2, "news.example.com", 0), (1, "example.com", 2)], "registry_ord int, domain string, tier int")
    got = {r.host: r.tier for r in A.source_tier(rows, registry, Params(domain_tiers=[("org$", 1)])).collect()}
    assert got == {"news.example.com": 2, "www.example.com": 2, "example.org": 1, "notexample.com": 3, None: 3}


def test_fresh_articles_boundaries(spark):
    rows = spark.createDataFrame([(i, NOW - dt.timedelta(hours=h) if h is not None else None) for i, h in enumerate([24, 264, -48, 96, -12, None])], "ord int, published_at timestamp")
    assert [r.ord for r in A.fresh_articles(rows, X.now()).orderBy("ord").collect()] == [0, 3, 4]


def greedy(n: int, related: set) -> list[int]:
    groups: list[list[int]] = []
    for i in range(n):
        for g in groups:
            if any((i, j) in related or (j, i) in related for j in g):
                g.append(i)
                break
        else:
            groups.append([i])
    return [next(g[0] for g in groups if i in g) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_are_those_of_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(14)]
    titles = [" ".join(rng.sample(words, rng.randint(2, 5))) for _ in range(60)]
    rows = [(i, t, NOW - dt.timedelta(hours=rng.randint(0, 30)), "news") for i, t in enumerate(titles)]
    table = spark.createDataFrame(rows, "ord long, title string, published_at timestamp, channel string")
    none = spark.createDataFrame([], "ord long, entity_id string")
    groups = cluster.title_groups(table, none, Params(stop_words=[], canonical={}))
    pairs = cluster.related_pairs(groups)
    got = {r.ord: r.cluster_id for r in cluster.cluster_articles(table, groups, pairs).collect()}
    order = sorted(rows, key=lambda r: (-r[2].timestamp(), r[0]))
    sets = [set(r[1].split()) for r in order]
    related = {(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.64}
    assert got == {order[i][0]: order[c][0] for i, c in enumerate(greedy(60, related))}


def test_plans_hold_no_cross_product(spark):
    from evidence_engine.queries import QUERIES

    for name in ("d1_match_entities", "d4_related_pairs", "d6_map_sources", "i5_contradictions", "j1_search"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_momentum_without_earlier_coverage(spark):
    rows = spark.createDataFrame([(1, "a.org", NOW - dt.timedelta(hours=1)), (1, "b.org", NOW - dt.timedelta(hours=2)), (2, "a.org", None)], "cluster_id int, host string, published_at timestamp")
    got = {r.cluster_id: (r.momentum, r.trend_change) for r in E.momentum(rows, X.now()).collect()}
    assert got == {1: (20 + 6 + 12 + 16, 100), 2: (6 + 8, 0)}


def test_merge_keeps_first_and_sticky_values(spark):
    old = spark.createDataFrame([(1, "a", "open"), (2, "a", "resolved"), (None, "a", "open")], "id int, first string, status string")
    new = spark.createDataFrame([(2, "b", "open"), (3, "b", "open"), (None, "b", "closed")], "id int, first string, status string")
    got = {r.id: (r.first, r.status) for r in merge_table(old, new, ["id"], insert_only=["first"], sticky={"status": "resolved"}).collect()}
    assert got == {1: ("a", "open"), 2: ("a", "resolved"), 3: ("b", "open"), None: ("a", "closed")}


def test_corrections_are_append_only_and_idempotent(spark):
    schema = "claim_id long, request_id string, created_at timestamp, text string, actor string"
    facts = spark.createDataFrame([(1, "fact"), (2, "interpretation")], "claim_id long, kind string")
    have = spark.createDataFrame([(1, "r0", NOW, "old", "ann")], schema)
    asked = spark.createDataFrame([(1, "r0", NOW, "old", "ann"), (1, "r1", NOW, "new", "ann"), (2, "r2", NOW, "x", "ann"), (1, "r3", NOW, "", "ann"), (1, "r4", NOW, "y", None), (9, "r5", NOW, "z", "ann")], schema)
    after, results = claims.apply_corrections(facts, have, asked)
    assert {r.request_id: r.result for r in results.collect()} == {"r0": "replayed", "r1": "applied", "r2": "rejected", "r3": "rejected", "r4": "rejected", "r5": "rejected"}
    assert after.count() == 2
    changed = spark.createDataFrame([(1, "r0", NOW, "other", "ann")], schema)
    assert claims.apply_corrections(facts, after, changed)[1].first().result == "conflict"


def test_corrections_come_one_by_one(spark):
    facts = spark.createDataFrame([(1, "fact"), (1, "fact")], "claim_id long, kind string")
    have = spark.createDataFrame([], "claim_id long, request_id string, created_at timestamp, text string, actor string")
    at = [NOW + dt.timedelta(minutes=i) for i in range(4)]
    asked = [
        (1, "a", at[0], "x", "ann", ["lost"]), (1, "a", at[1], "x", "ann", ["e"]), (1, "a", at[2], " x ", "ann", None), (1, "a", at[3], "y", "ann", []),
        (1, None, at[0], "x", "ann", []), (1, None, at[0], "x", "ann", []), (1, None, at[1], "z", " ", []), (1, "b" * 201, at[0], "x", "ann", []), (1, "c", at[0], "x" * 10001, "ann", []),
    ]
    rows = spark.createDataFrame(asked, "claim_id long, request_id string, created_at timestamp, text string, actor string, evidence_ids array<string>")
    proof = spark.createDataFrame([("e",), ("e",)], "evidence_id string")
    after, results = claims.apply_corrections(facts, have, rows, proof)
    assert sorted((r.request_id or "-")[:1] + " " + r.result for r in results.collect()) == ["- applied", "- applied", "- rejected", "a applied", "a conflict", "a rejected", "a replayed", "b rejected", "c rejected"]
    assert after.count() == 3
    assert [tuple(r) for r in claims.unknown_correction_evidence(rows, proof).collect()] == [("a", 1, "lost")]


def test_graph_gate_rules(spark):
    one = spark.range(1)
    c = spark.createDataFrame([("c1", "e1"), ("c2", "e1")], "claim_id string, event_id string")
    links = spark.createDataFrame([("c1", "p1"), ("c2", "p1")], "claim_id string, evidence_id string")
    proof = spark.createDataFrame([("p1",)], "evidence_id string")
    made = {"generated_at": "2024-01-31T00:00:00Z", "window_start": "2024-01-30T00:00:00Z", "window_end": "2024-01-31T00:00:00Z", "source_commit": "a" * 40, "source_repository": None, "source_run": "1", "source_attempt": None, "content": "b" * 64}
    head = one.select(*[F.lit(v).cast("string").alias(f"input_{k}") for k, v in made.items()])
    named = {"publishable": True, "unsupported_material": 0, "generated_at": made["generated_at"], "source_commit": "a" * 40, "events": 1, "claims": 2, "evidence": 1, "input_events": 1, "named_generated_at": made["generated_at"], "named_commit": "a" * 40, "named_run": "1"}
    head = head.withColumns({k: F.lit(v) for k, v in named.items()}).withColumns({"named_attempt": F.lit(None).cast("string"), "input_generation_id": claims.generation_id("input_")})

    def broken(h, minutes=10, **tables):
        t = {"claims": c, "links": links, "evidence": proof} | tables
        return {r.rule: r.violations for r in claims.graph_gate(t["claims"], t["links"], t["evidence"], h, F.lit(made["generated_at"]).cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES")).collect() if r.violations}

    assert broken(head) == {}
    assert broken(head, 181) == {"input_fresh": 1} and broken(head, 241) == {"input_fresh": 1, "fresh": 1} and broken(head, -2) == {"input_fresh": 1, "fresh": 1}
    assert broken(head, evidence=proof.filter("false")) == {"orphan_evidence": 2, "evidence_count": 1}
    assert broken(head.withColumns({"publishable": F.lit(None).cast("boolean"), "unsupported_material": F.lit(3), "events": F.lit(2)})) == {"publishable": 1, "unsupported_material": 1, "event_count": 1}
    assert broken(head.withColumn("input_source_run", F.lit("2"))) == {"input_identity": 1}
    assert broken(head.withColumn("generated_at", F.lit("2024-01-30T20:00:00Z"))) == {"fresh": 1, "input_before_graph": 1}


def test_contradictions_find_every_pair(spark):
    rng = random.Random(5)
    words = [f"term{i}" for i in range(9)]
    rows = [(i, f"s{i % 2}", " ".join(rng.sample(words, rng.randint(2, 5))) + (" not" if rng.random() < 0.5 else "")) for i in range(40)]
    got = {(r.a, r.b) for r in claims.contradictions(spark.createDataFrame(rows, "claim_id long, scope string, text string")).collect()}
    first: dict = {}
    for i, s, t in rows:
        w = frozenset(x for x in t.split() if len(x) >= 4)
        first.setdefault((s, w, t.endswith("not")), i)
    items = list(first.items())
    want = {(min(i, j), max(i, j)) for x, ((s, w, c), i) in enumerate(items) for (s2, w2, c2), j in items[:x] if s == s2 and c != c2 and len(w & w2) / min(len(w), len(w2)) >= 0.45}
    assert got == want and want


def test_freshness_boundaries(spark):
    ms = [0, 180 * 60_000, 180 * 60_000 + 1, -60_000, -60_001]
    rows = spark.createDataFrame([(i, NOW - dt.timedelta(milliseconds=x)) for i, x in enumerate(ms)] + [(9, None)], "run_id int, at timestamp")
    got = {r.run_id: r.verdict for r in audits.freshness_verdict(rows, "at", 180, X.now()).collect()}
    assert got == {0: "fresh", 1: "fresh", 2: "stale", 3: "fresh", 4: "future", 9: "invalid"}
    with pytest.raises(ValueError):
        audits.freshness_verdict(rows, "at", 29, X.now())


def test_ambiguous_registry_rows_serve_once(spark):
    expected = spark.createDataFrame([(1, "Ann Lee", "chair"), (2, "Ann Lee Ltd", "chair"), (3, "Bo", "ceo")], "id int, name string, title string")
    observed = spark.createDataFrame([(10, "Ann Lee", "chair"), (11, "New Person", "cfo")], "id int, name string, title string")
    got = {(r.change, r.id) for r in registry.registry_diff(expected, observed).collect()}
    assert got == {("unchanged", 1), ("ambiguous", 2), ("removal", 3), ("addition", 11)}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><item><title>Plant opens - Daily</title><link>https://x.org/1</link><pubDate>Wed, 31 Jan 2024 10:15:00 GMT</pubDate><description>&lt;p&gt;Big&lt;/p&gt;</description><source url='https://www.daily.org'>Daily</source></item>"
        "<item><title></title><link>https://x.org/2</link><pubDate>Wed, 31 Jan 2024 10:15:00 GMT</pubDate></item></channel></rss>"
    )
    row = feeds.rss_items(spark, str(tmp_path / "a.xml"), "g").collect()
    assert [(r.title, r.domain, r.source_name, r.description) for r in row] == [("Plant opens", "daily.org", "Daily", "Big")]
    (tmp_path / "b.xml").write_text("<feed><entry><title>Why?</title><summary>short</summary><content>long</content><published>2024-01-30T00:00:00Z</published><updated>2024-01-31T00:00:00Z</updated><link href='https://talk.org/1'/><author><name>bo</name></author></entry></feed>")
    row = feeds.atom_items(spark, str(tmp_path / "b.xml"), "g").collect()
    assert [(r.title, r.description, r.channel, r.published_at) for r in row] == [("Why?", "long", "public-conversation", dt.datetime(2024, 1, 31))]
    (tmp_path / "c.json").write_text('{"articles": [{"title": "t", "context": "", "description": "d", "url": "https://www.e.org/a", "seendate": "20240131T000000Z"}]}')
    row = feeds.json_articles(spark, str(tmp_path / "c.json"), "g").collect()
    assert [(r.description, r.domain, r.language) for r in row] == [("d", "e.org", "English")]


def test_snapshots_need_enough_checks(spark, tmp_path):
    rows = X.served(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        feeds.write_snapshot(rows, str(tmp_path / "s"), "r0", "a", "b", 10, 2)
    feeds.write_snapshot(rows, str(tmp_path / "s"), "r1", "a", "b", 10, 9)
    feeds.write_snapshot(rows.limit(3), str(tmp_path / "s"), "r2", "a", "b", 10, 9)
    assert feeds.read_snapshot_window(spark, str(tmp_path / "s"), F.lit("2000-01-01").cast("timestamp"), X.now()).count() == 3


def test_snapshots_are_served_by_policy(spark, tmp_path):
    def at(text):
        return F.lit(text).cast("timestamp")

    path = str(tmp_path / "p")
    feeds.write_snapshot(X.served(spark, "/root/testdata/sf0.001"), path, "r1", "2024-01-01 00:00:00", "2024-01-31 00:00:00", 10, 9)
    assert feeds.read_snapshot_window(spark, path, at("2024-01-02"), at("2024-01-30"), at("2024-01-31 01:00:00")).count() > 0
    ask = {"incomplete": ("2023-12-31", "2024-01-30", "01:00"), "stale": ("2024-01-02", "2024-01-30", "01:31"), "trailing": ("2024-01-02", "2024-01-31 00:30:00", "01:00"), "window_invalid": ("2024-01-03", "2024-01-03", "01:00")}
    for verdict, (low, high, now) in ask.items():
        with pytest.raises(ValueError, match=verdict):
            feeds.read_snapshot_window(spark, path, at(low), at(high), at(f"2024-01-31 {now}:00"))
    with pytest.raises(ValueError, match="future"):
        feeds.read_snapshot_window(spark, path, at("2024-01-02"), at("2024-01-30"), at("2024-01-30 23:58:00"))
    assert feeds.read_snapshot_window(spark, path, at("2024-01-02"), at("2024-01-31 00:30:00"), at("2024-01-31 01:00:00"), trailing_lag=True).count() > 0
    assert feeds.read_snapshot_window(spark, path, at("2023-12-31"), at("2024-01-30"), at("2024-01-31 01:00:00"), whole=False).count() > 0


def test_page_links_take_the_date_of_their_block(spark):
    from evidence_engine.sources.pages import page_links

    title = "A title that is long enough"
    html = (
        f"<ul><li>1 March 2024 <a href='/n/1?x=1'>{title} |</a></li><li><a href=\"/n/2\"><b>{title}</b></a> <i>Mar 2nd, 2024</i></li><li><a href='/n/1'>{title} again</a> 2024-03-09</li>"
        f"<li><a href='/n/3'>{title}</a></li><li><a href='/n/4'>Read more</a> 2024-03-04</li><li><a href='https://other.org/n/5'>{title}</a> 2024-03-05</li>"
        f"<li><a href='/x/6'>{title}</a> 2024-03-06</li><li><a href='/n/7/'>{title}</a> 31 February 2024</li></ul>" + "-" * 300 + f"<a href='n/8'>{title} &amp; more</a> 2024-03-08T10:00Z" + "+" * 300
    )
    pages = spark.createDataFrame([(1, "https://www.a.org/", html), (2, "https://www.a.org/", None), (3, None, html), (4, "https://www.a.org/", "")], "page_id int, url string, html string")
    got = [(r.link, r.title, str(r.published_on), r.nth) for r in page_links(pages, ["/n/"], ["/x/6$"]).orderBy("published_on").collect()]
    assert got == [("https://www.a.org/n/1", title, "2024-03-01", 0), ("https://www.a.org/n/2", title, "2024-03-02", 1), ("https://www.a.org/n/8", title + " & more", "2024-03-08", 8)]


def test_streams_equal_batches(spark, tmp_path):
    checks = X.checks(spark, "/root/testdata/sf0.001").orderBy("check_date").coalesce(1)
    checks.write.parquet(str(tmp_path / "checks"))
    got = streams.drain(streams.stream_baseline(streams.table_stream(spark, str(tmp_path / "checks"))), str(tmp_path / "run"))
    want = audits.learn_baselines(spark.read.parquet(str(tmp_path / "checks")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_conversation_attach(spark, tmp_path):
    media = [(1, "plant", NOW), (2, "court", NOW)]
    public = [(7, "plant", NOW + dt.timedelta(hours=3)), (8, "plant", NOW + dt.timedelta(hours=40)), (9, "court", NOW)]
    spark.createDataFrame(media, "ord long, token string, published_at timestamp").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame(public, "item long, token string, said_at timestamp").write.parquet(str(tmp_path / "p"))
    joined = streams.stream_conversation_attach(streams.table_stream(spark, str(tmp_path / "m")), streams.table_stream(spark, str(tmp_path / "p")))
    assert {(r.ord, r.item) for r in streams.drain(joined, str(tmp_path / "run")).collect()} == {(1, 7), (2, 9)}
