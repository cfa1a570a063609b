"""Evidence, claims, sources and stored rows on literal events."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from evidence_engine.operators import audits, claims, events
from evidence_engine.operators.search import answer_links

NOW = dt.datetime(2024, 1, 31)
SOURCE = "struct<url:string,link:string,authority:string,name:string,published_at:string,tier:int,official:boolean>"
EVENT = f"event_id string, title string, headline string, url string, source string, published_at string, latest_at string, summary string, facts array<string>, interpretations array<string>, entity_ids array<string>, status string, version int, sources array<{SOURCE}>"


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


def event(spark, **given):
    row = {"event_id": "e", "title": "T", "headline": "T", "facts": None, "interpretations": None, "sources": []} | given
    return spark.createDataFrame([tuple(row.get(c.split()[0]) for c in EVENT.split(f", sources")[0].split(", ")) + (row["sources"],)], EVENT)


def source(url=None, link=None, authority=None, name=None, published_at=None, tier=None, official=None):
    return (url, link, authority, name, published_at, tier, official)


def test_two_sources_on_one_address_are_two_pieces_of_evidence(spark):
    same = "https://a.org/x?utm_source=y#z"
    rows = claims.build_evidence(event(spark, published_at="2024-01-02", sources=[source(same, authority="A"), source(same, name="B", official=True), source(same, authority="A", tier=2), source("ftp://a", authority="C"), source(link="https://b.org/", published_at="2024-01-01")])).collect()
    got = {(r.authority, r.address, r.published_at, r.tier, r.official) for r in rows}
    assert got == {("A", "https://a.org/x", "2024-01-02", 2, False), ("B", "https://a.org/x", "2024-01-02", 0, True), ("Unknown source", "https://b.org/", "2024-01-01", 3, False)}
    assert {r.id for r in rows if r.authority == "A"} == {sha("evidence", "e", "https://a.org/x", "A", "2024-01-02")}


def test_an_event_without_a_good_source_stands_by_its_own_address(spark):
    rows = claims.build_evidence(event(spark, url="https://own.org/e", source="Desk", latest_at="2024-01-05", sources=[source("ftp://a")])).collect()
    assert [(r.authority, r.address, r.published_at, r.domain) for r in rows] == [("Desk", "https://own.org/e", "2024-01-05", "own.org")]
    # a source without an address takes the event's, so it is a good one
    assert [r.authority for r in claims.build_evidence(event(spark, url="https://own.org/e", source="Desk", sources=[source(name="N")])).collect()] == ["N"]
    assert claims.build_evidence(event(spark, sources=[source("ftp://a")])).count() == 0


def test_a_fact_stated_twice_is_two_claims(spark):
    table = claims.build_claims(event(spark, facts=["Same  thing", "", "Same thing", "see https://x.org/a now"], interpretations=[None, "Maybe"], entity_ids=["p", "", "p", "q"], status="strong", version=3))
    rows = table.collect()
    got = {(r.kind, r.sequence): r for r in rows}
    assert sorted(got) == [("fact", 1), ("fact", 2), ("fact", 3), ("interpretation", 1)]
    assert got["fact", 1].claim_id == sha("claim", "e", "fact", "same thing") and got["fact", 2].claim_id == sha("claim", "e", "fact", "1", "same thing")
    assert got["fact", 3].normalized_text == "see now" and got["fact", 1].entity_ids == ["p", "q"] and got["fact", 1].lifecycle == "strong" and got["fact", 1].version == 3
    assert claims.support_violations(table, spark.createDataFrame([], "claim_id string, evidence_id string, url string")).filter("rule = 'duplicate_claim'").count() == 0
    plain = claims.build_claims(event(spark, facts=[""], summary="", headline="Only this")).collect()
    assert [(r.text, r.lifecycle, r.version) for r in plain] == [("Only this", "observed", 1)]


def test_sources_by_suffix_and_name(spark):
    registry = spark.createDataFrame([(2, "example.com", "Parent", 1, "major-media"), (1, "news.example.com", "News", 2, ""), (3, "other.org", None, 0, "ratings")], "registry_ord int, domain string, name string, tier int, class string")
    rows = event(spark, sources=[source("https://a.news.example.com/1"), source("https://www.example.com/2", name="Own", tier=3), source("https://example.com/3", name="Later"), source("ftp://x", name="By Name"), source(name="by name"), source("https://other.org/", tier=1), source("https://notexample.com/")])
    got = {(r.name, r.domain, r.tier, r["class"]) for r in claims.evidence_sources(rows, registry).collect()}
    assert got == {("News", "a.news.example.com", 2, "discovery-index"), ("Own", "example.com", 3, "major-media"), ("By Name", "", 3, "discovery-index"), ("other.org", "other.org", 1, "ratings"), ("notexample.com", "notexample.com", 3, "discovery-index")}
    groups = {r.name: (r.configured, r.evidenced) for r in claims.coverage_snapshot(claims.evidence_sources(rows, registry), registry).collect()}
    assert groups == {"Major journalism": (1, 1), "Specialist & regional media": (1, 0), "Other evidence": (1, 1), "Open discovery": (0, 3)}


def test_stored_rows_take_the_first_date_of_their_sources(spark):
    kind = "event_id string, headline string, bucket string, status string, summary string, why string, published_at timestamp, updated_at timestamp, materiality string, sentiment double, confidence string, source_count int, sources array<struct<published_at:string>>"
    table = spark.createDataFrame([("a", "h", "must", "confirmed", "s", "w", NOW, None, "12.5", 3.0, "sure", 0, [("2024-01-09",), ("bad",), ("2024-01-03T00:00:00Z",)]), ("b", "h", "must", "strong", "s", "w", None, NOW, "NaN", None, "high", 9, [("",)])], kind)
    a, b = events.stored_rows(table, F.lit(NOW)).orderBy("event_id").collect()
    assert (a.first_reported_at, a.materiality, a.media_tone, a.confidence, a.source_count, a.lifecycle, a.category) == (dt.datetime(2024, 1, 3), 12.5, 3.0, "unavailable", 3, "confirmed", "Corporate")
    assert (b.first_reported_at, b.published_at, b.materiality, b.confidence, b.source_count, b.lifecycle) == (NOW, NOW, None, "high", 9, "developing")


def test_references_by_any_spelling(spark):
    table = spark.createDataFrame([(1, " R1 ", None, ["r1", "R2"]), (2, None, ["", None], []), (3, "", ["r3"], None)], "event_id int, reference_id string, matches array<string>, benchmark_reference_ids array<string>")
    assert sorted(map(tuple, audits.reference_ids(table).collect())) == [(1, "r1"), (1, "r2"), (3, "r3")]
    refs = spark.createDataFrame([("R3 ",), ("r9",)], "ref_id string")
    assert {r.ref_id: r.detected for r in audits.match_references(refs, table).collect()} == {"R3 ": True, "r9": False}


def test_links_of_answers_are_distinct_and_in_order(spark):
    answers = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b")], "qid int, rank int, event_id string")
    stored = spark.createDataFrame([("a", [("u1", "x"), ("u2", "y")]), ("b", [("u2", "z"), ("u3", "w")])], "event_id string, sources array<struct<url:string,name:string>>")
    assert sorted(map(tuple, answer_links(answers, stored).collect())) == [(1, 1, "u1", "x"), (1, 2, "u2", "y"), (1, 3, "u3", "w"), (2, 1, "u2", "z"), (2, 2, "u3", "w")]
