"""Queries over feeds, dates, labels, streams and reports that are made from the tables, with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine import fixtures as X
from evidence_engine.fixtures import with_views
from evidence_engine.functions import scores as S
from evidence_engine.functions.text import canonical_url, parse_feed_date, strict_offset, strict_utc, tone_label
from evidence_engine.operators import audits as A
from evidence_engine.operators import articles, events, governance
from evidence_engine.params import COVERAGE_GROUP, SOURCE_CLASS
from evidence_engine.plans.materialize import shared_dir
from evidence_engine.queries import sqltext as T
from evidence_engine.queries.audit import _BASE, _REFS, dated, pct
from evidence_engine.queries.gates import _stored
from evidence_engine.sources import feeds
from evidence_engine.streaming import streams as K

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _xml(text: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def _files(rows: DataFrame, item: Column, path: str, before: str, after: str) -> None:
    """Documents of at most 250 items, one to a file, as feeds come."""
    lists = rows.groupBy(F.floor(F.col("ord") / 250).alias("list")).agg(F.concat(F.lit(before), F.array_join(F.collect_list(item), ""), F.lit(after)).alias("value"))
    lists.write.partitionBy("list").text(path)


def _tag(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _xml(text), F.lit(f"</{name}>"))


@query("a1_read_dimension", "SELECT 'n' || n_nationkey AS id, n_name AS name, CAST(n_regionkey AS INT) AS tier FROM nation")
def read_dimension(spark: SparkSession, d: str) -> DataFrame:
    path, nation = _place(spark), X.table(spark, d, "nation")
    rows = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("tier"), F.array("n_name").alias("aliases"))
    # one JSON document for each region, as registries come
    rows.groupBy("tier").agg(F.to_json(F.collect_list(F.struct("id", "name", "tier", "aliases"))).alias("value")).write.partitionBy("tier").text(path)
    return feeds.read_dimension(spark, path, feeds.ENTITY).select("id", "name", "tier")


@query("a2_rss_items", with_views(f"SELECT trim(title) AS title, {T.cleaned('description')} AS description, regexp_replace(url, '\\?.*$', '') AS url, replace(host, 'www.', '') AS domain, published_at, source_name FROM articles WHERE trim(title) <> ''", "articles"))
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    path, a = _place(spark), X.articles(spark, d)
    stamp = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    source = F.concat(F.lit('<source url="https://'), "host", F.lit('/">'), "source_name", F.lit("</source>"))
    item = F.concat(F.lit("<item>"), _tag("title", F.concat("title", F.lit(" - "), "source_name")), _tag("link", F.regexp_replace("url", r"\?.*$", "")), _tag("description", F.col("description")), _tag("pubDate", stamp), source, F.lit("</item>"))
    _files(a.filter("trim(title) <> ''"), item, path, "<rss><channel>", "</channel></rss>")
    return feeds.rss_items(spark, path, "group").select("title", "description", "url", "domain", "published_at", "source_name")


@query("a3_atom_items", with_views(f"SELECT trim(title) AS title, CASE WHEN ord % 2 = 0 THEN {T.cleaned('description')} ELSE source_name END AS description, regexp_replace(url, '\\?.*$', '') AS url, published_at, source_name FROM articles WHERE channel = 'public-conversation' AND trim(title) <> ''", "articles"))
def atom_items(spark: SparkSession, d: str) -> DataFrame:
    path, a = _place(spark), X.articles(spark, d).filter("channel = 'public-conversation' AND trim(title) <> ''")
    text = F.when(F.col("ord") % 2 == 0, F.col("description")).otherwise("")
    short = F.when(F.col("ord") % 2 == 0, F.lit("")).otherwise(F.col("source_name"))
    link = F.concat(F.lit('<link href="'), F.regexp_replace("url", r"\?.*$", ""), F.lit('"/>'))
    author = F.concat(F.lit("<author>"), _tag("name", F.col("source_name")), F.lit("</author>"))
    entry = F.concat(F.lit("<entry>"), _tag("title", F.col("title")), _tag("content", text), _tag("summary", short), _tag("updated", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), link, author, F.lit("</entry>"))
    _files(a, entry, path, "<feed>", "</feed>")
    return feeds.atom_items(spark, path, "group").select("title", "description", "url", "published_at", "source_name")


@query("a4_json_articles", with_views("SELECT title, CASE WHEN ord % 3 = 0 THEN language ELSE source_name END AS description, url, published_at, language FROM articles", "articles"))
def json_articles(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark)
    context = F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.col("source_name"))
    item = F.struct("title", context.alias("context"), F.col("language").alias("description"), "url", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), "language")
    # lists of at most 250 articles, one to a file
    lists = X.articles(spark, d).groupBy(F.floor(F.col("ord") / 250).alias("list")).agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("value"))
    lists.write.partitionBy("list").text(path)
    return feeds.json_articles(spark, path, "group").select("title", "description", "url", "published_at", "language")


@query("b5_parse_feed_date", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'none' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def feed_dates(spark: SparkSession, d: str) -> DataFrame:
    forms = {0: "yyyyMMddHHmmss", 1: "yyyy-MM-dd'T'HH:mm:ss'Z'", 2: "EEE, dd MMM yyyy HH:mm:ss 'GMT'"}
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id")
    text = F.when(k % 11 == 0, "soon").otherwise(F.coalesce(*[F.when(k % 3 == i, F.date_format(ts, f)) for i, f in forms.items()]))
    return X.table(spark, d, "events").select("event_id", F.coalesce(F.date_format(parse_feed_date(text), "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("at"))


@query("b6_strict_utc", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'none' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def strict_dates(spark: SparkSession, d: str) -> DataFrame:
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id")
    text = F.when(k % 7 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k % 11 == 0, F.lit("2023-02-30T01:00:00Z")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.5Z'"))
    return X.table(spark, d, "events").select("event_id", F.coalesce(F.date_format(strict_utc(text), "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("at"))


@query("b6_strict_offset", """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN 'none' ELSE strftime(date_trunc('second', ts) - CASE WHEN event_id % 3 = 0 THEN INTERVAL 330 MINUTES WHEN event_id % 3 = 1 THEN INTERVAL '-20 hours' ELSE INTERVAL 0 HOURS END, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def offset_dates(spark: SparkSession, d: str) -> DataFrame:
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id")
    zone = F.when(k % 3 == 0, "+05:30").when(k % 3 == 1, "-20:00").otherwise("z")
    good = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(k % 2 == 0, ".123456").otherwise(""), zone)
    text = F.when(k % 7 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k % 11 == 0, F.lit("2023-02-29T01:00:00+00:00")).when(k % 13 == 0, F.lit("2023-02-28T01:00:00+24:00")).otherwise(good)
    return X.table(spark, d, "events").select("event_id", F.coalesce(F.date_format(strict_offset(text), "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("at"))


_KINDS = [*SOURCE_CLASS, "unheard"]


def _cases(x: str, table: dict, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {T.quoted(k)} THEN {T.quoted(v)}" for k, v in table.items()) + f" ELSE {T.quoted(other)} END"


@query("b25_labels", with_views(f"""+ k AS (SELECT event_id, tone, {T.listed(_KINDS)}[event_id % {len(_KINDS)} + 1] AS kind, event_id % 5 AS tier, event_id % 2 = 0 AS known FROM served),
t AS (SELECT *, CASE tier WHEN 0 THEN 'official' WHEN 1 THEN 'major-media' WHEN 2 THEN 'specialist-media' ELSE 'discovery-index' END AS by_tier FROM k)
SELECT event_id, CASE WHEN tone >= 25 THEN 'Positive' WHEN tone <= -25 THEN 'Negative' ELSE 'Neutral / mixed' END AS tone_label, {_cases("kind", SOURCE_CLASS, "discovery")} AS class, by_tier, {_cases("CASE WHEN known THEN kind ELSE by_tier END", COVERAGE_GROUP, "Other evidence")} AS shown FROM t""", "served"))
def labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    tier = F.col("event_id") % 5
    return X.served(spark, d).select("event_id", tone_label(F.col("tone")).alias("tone_label"), S.source_class(kind).alias("class"), S.class_from_tier(tier).alias("by_tier"), S.coverage_group(F.when(F.col("event_id") % 2 == 0, kind), tier).alias("shown"))


@query("b8_https_only", with_views("SELECT evidence_id, CASE WHEN tier = 1 OR url NOT LIKE 'https%' THEN 'none' ELSE url END AS address FROM evidence", "evidence"))
def https_only(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("tier") == 1, F.regexp_replace("url", "^https://", "https://user@")).otherwise(F.col("url"))
    return X.evidence(spark, d).select("evidence_id", F.coalesce(canonical_url(url, "https"), F.lit("none")).alias("address"))


@query("c2_in_window", with_views("SELECT ord, published_at FROM articles WHERE published_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-11 12:00:00'", "articles"))
def in_window(spark: SparkSession, d: str) -> DataFrame:
    low, high = (F.lit(t).cast("timestamp") for t in ("2024-01-08 00:00:00", "2024-01-11 12:00:00"))
    return articles.in_window(X.articles(spark, d), low, high).select("ord", "published_at")


@query("e25_coverage_gaps", with_views(f"""+ en(entity_id, type, tier, k) AS (VALUES {", ".join(f"({T.quoted(e[0])}, {T.quoted(e[2])}, {e[3]}, {k})" for k, e in enumerate(X.ENTITIES))}),
sv AS (SELECT *, {T.listed(e[0] for e in X.ENTITIES)}[event_id % {len(X.ENTITIES)} + 1] AS entity FROM served WHERE bucket = 'must'),
r AS (SELECT count(*) FILTER (NOT ok) AS errors, count(*) FILTER (tier0) AS pc, count(*) FILTER (tier0 AND ok AND item_count > 1000) AS ps FROM checks),
g AS (SELECT 'live_error' AS kind, CASE WHEN errors > 0 THEN 1 ELSE 0 END AS n FROM r UNION ALL SELECT 'provider_errors', errors FROM r
UNION ALL SELECT 'companies_unreconciled', CASE WHEN count(*) <> 4 THEN count(*) ELSE 0 END FROM en WHERE type = 'company' UNION ALL SELECT 'leadership_unreconciled', CASE WHEN count(*) <> 2 THEN count(*) ELSE 0 END FROM en WHERE type = 'person'
UNION ALL SELECT 'registry_changed', count(*) FILTER (n_nationkey % 3 = 0) FROM nation UNION ALL SELECT 'priority_without_event', count(*) FROM en WHERE k % 2 = 0 AND tier <= 1 AND entity_id NOT IN (SELECT entity FROM sv)
UNION ALL SELECT 'material_but_uncertain', count(*) FILTER (materiality >= 70 AND certainty < 65) FROM sv UNION ALL SELECT 'public_unavailable', CASE WHEN pc > 0 AND ps = 0 THEN 1 ELSE 0 END FROM r UNION ALL SELECT 'closed_social', 1)
SELECT kind, CAST(n AS BIGINT) AS n FROM g WHERE n > 0""", "served", "checks"))
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    errors, public = F.count_if(~F.col("ok")), F.count_if("tier0")
    run = X.checks(spark, d).agg(F.when(errors > 0, "error").otherwise("ok").alias("live_status"), errors.alias("provider_errors"), public.alias("public_checks"), F.count_if(F.col("tier0") & F.col("ok") & (F.col("item_count") > 1000)).alias("public_succeeded"))
    run = run.withColumns({"expected_companies": F.lit(4), "expected_leadership": F.lit(2)})
    registries = X.table(spark, d, "nation").select((F.col("n_nationkey") % 3 != 0).alias("reconciled"))
    governed = X.entities(spark).withColumn("coverage_required", F.col("position") % 2 == 0)
    return events.coverage_gaps(_stored(spark, d).filter("bucket = 'must'"), governed, run, registries)


@query("e27_daily_ledger", with_views(_REFS + f""", a AS (SELECT count(*) AS refs, count(*) FILTER (detected) AS hits, sum(w) AS weight, sum(CASE WHEN detected THEN w ELSE 0 END) AS fw, count(*) FILTER (materiality = 'critical') AS c, count(*) FILTER (materiality = 'critical' AND detected) AS ch FROM m),
p AS (SELECT count(*) AS detections, count(*) FILTER (ref_id IN (SELECT ref_id FROM reference_events)) AS rgt FROM detections),
o AS (SELECT {pct("rgt", "detections", 2)} AS precision, {pct("fw", "weight", 2)} AS weighted_recall, {pct("ch", "c", 2)} AS critical_recall FROM a, p),
s AS (SELECT check_date, count(*) AS query_count, count(*) FILTER (ok) AS successful, CAST(sum(item_count) AS BIGINT) AS event_count FROM checks GROUP BY check_date)
SELECT check_date::VARCHAR AS day, precision >= 90 AND weighted_recall >= 98 AND critical_recall >= 100 AS pass, precision, weighted_recall, critical_recall, query_count, successful, query_count - successful AS failed, event_count FROM s, o""", "reference_events", "detections", "checks"))
def daily_ledger(spark: SparkSession, d: str) -> DataFrame:
    scans = X.checks(spark, d).groupBy(F.col("check_date").alias("day")).agg(F.count(F.lit(1)).alias("query_count"), F.count_if("ok").alias("successful"), F.sum("item_count").alias("event_count"))
    return dated(A.daily_ledger_entries(governance.dependability(X.reference_events(spark, d), X.detections(spark, d)), scans))


@query("k1_stream_ingest", with_views("SELECT ord, published_at FROM articles WHERE ord % 10 <> 0 AND ord % 13 <> 0", "articles"))
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    place, k = _place(spark), F.col("ord")
    X.articles(spark, d).select("ord", F.when(k % 10 == 0, F.lit("2999-01-01").cast("timestamp")).when(k % 13 != 0, F.col("published_at")).alias("published_at")).write.parquet(f"{place}/in")
    return K.drain(K.stream_ingest(K.table_stream(spark, f"{place}/in")), f"{place}/run")


@query("k4_stream_baseline", with_views(_BASE + " SELECT source_id, check_date::VARCHAR AS check_date, coalesce(typical, -1) AS typical, coalesce(minimum, -1) AS minimum FROM b", "checks"))
def stream_baseline(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark)
    X.checks(spark, d).select("source_id", "check_date", "item_count", "ok").write.parquet(f"{place}/in")
    rows = K.drain(K.stream_baseline(K.table_stream(spark, f"{place}/in")), f"{place}/run")
    return dated(rows.fillna(-1, ["typical", "minimum"]))


@query("k7_conversation_attach", with_views("""SELECT m.ord, p.ord AS item, m.language AS token FROM articles m JOIN articles p ON m.language = p.language AND m.channel = 'news' AND p.channel <> 'news'
AND p.published_at BETWEEN m.published_at - INTERVAL 24 HOURS AND m.published_at + INTERVAL 24 HOURS""", "articles"))
def conversation_attach(spark: SparkSession, d: str) -> DataFrame:
    place, a = _place(spark), X.articles(spark, d)
    a.filter("channel = 'news'").select("ord", F.col("language").alias("token"), "published_at").write.parquet(f"{place}/media")
    a.filter("channel <> 'news'").select(F.col("ord").alias("item"), F.col("language").alias("token"), F.col("published_at").alias("said_at")).write.parquet(f"{place}/public")
    pairs = K.stream_conversation_attach(K.table_stream(spark, f"{place}/media"), K.table_stream(spark, f"{place}/public"))
    return K.drain(pairs, f"{place}/run")
