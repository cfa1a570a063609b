"""Gates, audits, searches and rules on literal rows: what each branch gives."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from evidence_engine.functions import scores as S
from evidence_engine.operators import articles, audits, cluster, coverage, governance, health, history, registry, search, validation, windows
from evidence_engine.operators.events import coverage_gaps
from evidence_engine.params import Params
from evidence_engine.plans import merge
from evidence_engine.streaming import streams

SOURCES = "array<struct<url:string>>"


def test_validate_events(spark):
    good = ("e1", "h", "s", "w", "must", "strong", [("https://a.example.com",)])
    rows = [(1, *good), (2, *good[:6], []), (3, *good[:6], None), (4, *good[:6], [("https://a",), ("ftp://b",)]), (5, "", *good[1:]), (6, *good[:4], "later", None, good[6]), (7, *good), (8, *good)]
    table = spark.createDataFrame(rows, f"ord int, event_id string, headline string, summary string, why string, bucket string, status string, sources {SOURCES}").withColumn("call", F.lit(1))
    got = {r.ord: (r.verdict, list(r.problems)) for r in validation.validate_events(table, "call", "ord", 2).collect()}
    assert got[1] == ("accepted", []) and got[7] == ("accepted", []) and got[8] == ("over_limit", [])
    assert got[2][1] == got[3][1] == ["no_source"] and got[4][1] == ["unsafe_source"] and got[5][1] == ["event_id_missing"] and got[6][1] == ["bucket", "status"]


def test_validate_observations(spark):
    rows = [(1, "12.6", "3", "2024-01-01T00:00:00Z"), (2, "101", None, None), (3, "x", "", ""), (4, "0", "-1", None), (5, "0", "1", "soon"), (6, None, None, None)]
    table = spark.createDataFrame(rows, "n int, tone_score string, engagement_count string, published_at string").withColumns({"event_id": F.lit("e"), "platform": F.lit("p"), "source_url": F.lit("https://p/1")})
    got = {r.n: list(r.problems) for r in validation.validate_observations(table).collect()}
    assert got == {1: [], 2: ["tone"], 3: ["tone"], 4: ["engagement"], 5: ["date"], 6: ["tone"]}
    row = validation.observation_rows(table.filter("n = 1").withColumn("accessible_publicly", F.lit(None).cast("boolean"))).first()
    assert (row.tone_score, row.engagement_count, row.accessible_publicly) == (13, 3, True)


def test_source_health_issues(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("a", 10, True, None, 5.0, True, True), ("b", 1, True, None, None, True, False), ("c", 9, False, None, 5.0, True, True), ("d", 9, True, "degraded", 5.0, True, True), ("e", 10, True, None, 5.0, False, True)]
    checks = spark.createDataFrame([(k, day, n, ok, st, lat, rec, rev, k in "ce") for k, n, ok, st, lat, rec, rev in rows], "source_id string, check_date date, item_count long, ok boolean, status string, latency_ms double, reconciled boolean, reviewed boolean, tier0 boolean")
    base = spark.createDataFrame([(k, day, 10, 4) for k in "abcde"], "source_id string, check_date date, typical long, minimum long")
    found = health.source_health(checks, base)
    assert {r.source_id: r.issues for r in found.collect()} == {"a": "", "b": "below_minimum_volume,severe_volume_drop,latency_unmeasured,baseline_unreviewed", "c": "request_failed", "d": "provider_degraded", "e": "registry_drift"}
    row = health.health_summary(found).first()
    assert (row.healthy, row.degraded, row.explicit_failures, row.silent_failures, row.success_pct) == (1, 1, 1, 2, 20.0)
    assert not (row.gate_tier0_explicit or row.gate_tier0_silent or row.gate_success) and row.gate_baselines


def test_registry_diff_without_titles_and_by_alias(spark):
    schema = "id string, name string, title string, aliases array<string>"
    expected = spark.createDataFrame([("1", "Alpha Limited", None, []), ("2", "Beta & Sons", "CEO", ["Old Beta"]), ("3", "Gamma", "CFO", []), ("4", "Delta", "x", [])], schema)
    observed = spark.createDataFrame([("a", "ALPHA ltd", "Chair", []), ("b", "Someone", "Chief", ["Old  beta"]), ("c", "Gamma", "Other", []), ("d", "gamma inc", "cfo", []), ("e", "New", None, [])], schema)
    got = {(r.change, r.id): r.to_title for r in registry.registry_diff(expected, observed).collect()}
    assert got == {("unchanged", "1"): "Chair", ("role_change", "2"): "Chief", ("unchanged", "3"): "cfo", ("removal", "4"): None, ("addition", "c"): "Other", ("addition", "e"): None}


def _events(spark):
    rows = [(1, "alpha beta gamma", "must", 90, "strong", 0, 30, ["x"]), (2, "alphabet soup", "other", 10, "confirmed", 80, -5, ["y"]), (3, "beta delta", "watch", 50, "developing", 40, 25, ["x", "y"])]
    schema = "event_id int, headline string, bucket string, materiality int, status string, drift int, tone int, entity_ids array<string>"
    return spark.createDataFrame(rows, schema).withColumns({"category": F.lit("Corporate"), "updated_at": F.lit("2024-01-01").cast("timestamp"), "published_at": F.lit("2024-01-01").cast("timestamp"), "source_count": F.lit(1), "certainty": F.lit(60)})


def test_search_by_substring_words_and_facet(spark):
    asks = [(1, "alpha", "all"), (2, "lphab", "all"), (3, "beta zeta", "all"), (4, "", "watch"), (5, "beta", "confirmed"), (6, "ta", None)]
    got = {(r.qid, r.event_id) for r in search.search(spark.createDataFrame(asks, "qid int, text string, facet string"), _events(spark), Params(stop_words=[], canonical={})).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (3, 1), (3, 3), (4, 3), (6, 1), (6, 3)}


def test_answer_by_intent_and_entity(spark):
    asks = [(1, "what must know today"), (2, "any misattribution"), (3, "what is uncertain"), (4, "good news"), (5, "beta of x")]
    mentions = spark.createDataFrame([(5, "x")], "qid int, entity_id string")
    got = {}
    for r in search.answer(spark.createDataFrame(asks, "qid int, text string"), _events(spark), mentions, Params(stop_words=[], canonical={})).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.event_id, r.score))
    assert got == {1: [(1, 0)], 2: [(2, 0), (3, 0)], 3: [(1, 0), (3, 0)], 4: [(1, 0), (3, 0)], 5: [(1, 5), (3, 5)]}


def test_coverage_terms_are_whole_words(spark):
    entities = spark.createDataFrame([("ent one", ["Big Name"]), ("e2", ["abc"])], "entity_id string, terms array<string>")
    corpora = spark.createDataFrame([(1, "the big name group", []), (2, "bigname abc", []), (3, "none", ["E2"]), (4, None, None)], "corpus_id int, corpus string, scope array<string>")
    assert {(r.entity_id, r.corpus_id) for r in coverage.coverage_matches(entities, corpora).collect()} == {("ent one", 1), ("e2", 3)}


def test_dependability_gates(spark):
    refs = spark.createDataFrame([("a", "critical", None), ("b", "high", None), ("c", "low", 9.0)], "ref_id string, materiality string, weight double")
    hits = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e2", "zz")], "event_id string, ref_id string")
    row = governance.dependability(refs, hits).first()
    assert (row.refs, row.events, row.matched, row.high, row.high_hits, row.precision, row.weighted_recall) == (3, 2, 1, 3, 2, 50.0, 43.75)
    assert row.gate_critical and row.gate_claims and not row.gate_precision and not row["pass"]
    empty = governance.dependability(refs.limit(0), hits.limit(0)).first()
    assert empty.precision == 0 and not empty.gate_critical


def test_support_policy_refuses_foreign_evidence(spark):
    claims = spark.createDataFrame([("c1", "e1", "fact"), ("c2", "e2", "interpretation")], "claim_id string, event_id string, kind string")
    evidence = spark.createDataFrame([("v1", "e1", "https://a.example.com/1"), ("v2", "e2", "https://b.example.com/1")], "evidence_id string, event_id string, url string")
    links = spark.createDataFrame([("c1", "v1"), ("c2", "v2")], "claim_id string, evidence_id string")
    out = governance.apply_support_policy(claims, evidence, links)
    assert {r.claim_id: r.support for r in out["claims"].collect()} == {"c1": "provisional", "c2": "interpretation"}
    assert out["summary"].first().provisional == 1 and {r.status for r in out["events"].collect()} == {"developing"}
    with pytest.raises(ValueError, match="missing_or_foreign_evidence c1"):
        governance.apply_support_policy(claims, evidence, links.union(spark.createDataFrame([("c1", "v2")], links.schema)))


def test_reliability_reasons(spark):
    start = datetime.date(2024, 1, 1)
    day = lambda i: start + datetime.timedelta(days=i)
    rows = [(day(i), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i + 1, hours=1), 2, 2, 9, 9, 0, 0, "https://a.example.com/x", "0" * 64, "https://b.example.com/x", "f" * 64) for i in range(30)]
    schema = "day date, recorded_at timestamp, critical int, critical_detected int, high_weight int, high_detected int, unsupported int, outages int, production_url string, production_sha string, independent_url string, independent_sha string"
    now = F.lit("2024-03-01").cast("timestamp")
    assert governance.reliability_reasons(spark.createDataFrame(rows, schema), now).count() == 0
    rows[3] = (rows[3][0], rows[3][1], 2, 1, *rows[3][4:])
    got = {r.reason: r.n for r in governance.reliability_reasons(spark.createDataFrame(rows[:-1], schema), now, connected=False).collect()}
    assert got == {"references_not_connected": 1, "day_count": 1, "safety_gate_failed": 1, "critical_recall": 1}


def test_days_and_months(spark):
    texts = ["2024-02-29", "2024-02-30", "2024-05", "2024-13", "May 2024", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(history.day_of(F.col("t")).cast("string").alias("a"), history.day_of(F.col("t"), month=False).cast("string").alias("b")).collect()
    assert [r.a for r in rows] == ["2024-02-29", None, "2024-05-01", None, None, None] and [r.b for r in rows] == ["2024-02-29", None, None, None, None, None]


def test_hints_count_in_the_text_only(spark):
    a = spark.createDataFrame([(1, "plain words", "", "https://x.example.com/1", "x.example.com", "news", False, ["e1", "unknown"])], "ord int, title string, description string, url string, host string, channel string, official boolean, hints array<string>")
    entities = spark.createDataFrame([("e1", "Zeta", "company", 0, None, False, [], [])], "entity_id string, name string, type string, tier int, parent_id string, ambiguous boolean, aliases array<string>, context array<string>")
    sources = spark.createDataFrame([("y.example.com", 0, 0)], "domain string, tier int, registry_ord int")
    row = articles.assess_relevance(a, entities, sources).first()
    assert (row.reason, row.entity_ids, row.include_as_news) == ("entity_only_in_snippet", "e1", False)


def test_summary_leaves_out_a_snippet_that_repeats_the_title(spark):
    rows = [("Plant opens in the north today", "Plant opens in the north today, the firm said", False, 1), ("Plant opens", "Other words", False, 2), ("Plant opens", "", True, 1)]
    table = spark.createDataFrame(rows, "title string, text string, official boolean, n int")
    got = [r.s for r in table.select(S.event_summary(F.col("title"), F.col("text"), F.col("n"), F.col("official"), F.lit("Zeta")).alias("s")).collect()]
    assert "1 distinct source domain identifies" in got[0] and "the firm said" not in got[0] and "2 distinct source domains identifies" in got[1] and "Zeta. Other words " in got[1] and got[2].startswith("An official source")


def test_coverage_gaps_name_what_is_missing(spark):
    events = _events(spark).withColumn("certainty", F.lit(50))
    entities = spark.createDataFrame([("x", "company", 0, True), ("z", "person", 1, True), ("w", "company", 3, True)], "entity_id string, type string, tier int, coverage_required boolean")
    run = spark.createDataFrame([("ok", 2, 3, 0, 2, 5)], "live_status string, provider_errors int, public_checks int, public_succeeded int, expected_companies int, expected_leadership int")
    registries = spark.createDataFrame([(True,), (False,)], "reconciled boolean")
    got = {r.kind: r.n for r in coverage_gaps(events, entities, run, registries).collect()}
    assert got == {"provider_errors": 2, "leadership_unreconciled": 1, "registry_changed": 1, "priority_without_event": 1, "material_but_uncertain": 1, "public_unavailable": 1, "closed_social": 1}


def test_user_windows_over_midnight(spark):
    w = spark.createDataFrame([(1, "e", datetime.datetime(2024, 1, 1, 23), datetime.datetime(2024, 1, 3, 1))], "user_id int, entity_id string, start timestamp, end timestamp")
    e = spark.createDataFrame([(i, "e", datetime.datetime(2024, 1, 1, 22) + datetime.timedelta(hours=6 * i)) for i in range(6)], "event_id int, entity_id string, published_at timestamp")
    assert {r.event_id for r in windows.events_for_users(w, e).collect()} == {1, 2, 3, 4}


def test_attach_public_needs_a_common_entity(spark):
    members = spark.createDataFrame([(1, 10), (2, 20)], "cluster_id int, ord int")
    public = spark.createDataFrame([(30,)], "ord int")
    groups = spark.createDataFrame([(10, "g", ["a"]), (20, "g", ["a"]), (30, "g", ["a"])], "ord int, group_id string, tokens array<string>")
    pairs = spark.createDataFrame([], "a string, b string")
    matches = spark.createDataFrame([(10, "x", "company"), (20, "y", "company"), (30, "x", "company")], "ord int, entity_id string, type string")
    assert [tuple(r) for r in cluster.attach_public(members, public, groups, pairs, matches).collect()] == [(1, 30)]


def test_drain_keeps_the_last_table_of_complete_mode(spark, tmp_path):
    rows = [("a", datetime.datetime(2024, 1, 1, 3, h)) for h in range(5)] + [("b", datetime.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "key string, ts timestamp").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.table_stream(spark, f"{tmp_path}/in", files_per_batch=1)
    got = streams.drain(streams.stream_panes(stream, "ts", "key"), f"{tmp_path}/run", "complete")
    assert {(r.key, r.n) for r in got.collect()} == {("a", 5), ("b", 1)}


def test_entity_source_coverage(spark):
    entities = spark.createDataFrame(
        [("a", "A", "company", True, False, False, None), ("b", "B", "person", False, False, False, "https://x/Leadership"), ("c", "C", "person", False, False, False, None)],
        "entity_id string, name string, type string, official_company boolean, family boolean, leader boolean, source_url string",
    )
    sources = spark.createDataFrame([(1, "z", "registry", 0), (2, "y", "official", None), (3, "x", "query", None)], "source_id long, label string, kind string, tier int")
    mapped = spark.createDataFrame([("a", 1, 0.65, "name"), ("b", 2, 1.0, "reference"), ("b", 3, 1.0, "reference"), ("b", 3, 0.65, "name")], "entity_id string, source_id long, confidence double, matched_by string")
    rows = {r.entity_id: r for r in audits.entity_source_coverage(entities, mapped, sources).collect()}
    assert (rows["a"].status, rows["a"].direct, rows["a"].discovery, rows["a"].gaps) == ("covered", 1, 1, "no-direct-authoritative-adapter")
    assert (rows["b"].status, rows["b"].sources, rows["b"].methods, rows["b"].priority_reason) == ("covered", "2,3", "reference", "official-leadership-register")
    assert (rows["c"].status, rows["c"].priority, rows["c"].gaps) == ("gap", False, "no-direct-tier-0-source,no-discovery-or-media-map")


@pytest.mark.parametrize("change, rule", [({"quality": (False, 0)}, "not_publishable"), ({"quality": (True, 2)}, "unsupported_material"), ({"links": ("c", "absent")}, "unknown_evidence")])
def test_refused_graphs_change_nothing(spark, change, rule):
    quality, link = change.get("quality", (True, 0)), change.get("links", ("c", "e"))
    empty = spark.createDataFrame([], "evidence_id string, first_run string, last_run string")
    graph = {"quality": spark.createDataFrame([quality], "publishable boolean, unsupported_material long"), "links": spark.createDataFrame([link], "claim_id string, evidence_id string"), "evidence": spark.createDataFrame([("e",)], "evidence_id string")}
    with pytest.raises(ValueError, match=rule):
        merge.upsert_claim_graph({"evidence": empty}, graph, "c1", "2024-01-31")
    with pytest.raises(ValueError, match="commit"):
        merge.upsert_claim_graph({"evidence": empty}, graph, "", "2024-01-31")
