"""Queries over health, reliability, registries and coverage, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine import fixtures as X
from evidence_engine.fixtures import with_views
from evidence_engine.operators import audits as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def dated(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines give the same value."""
    return df.select(*[F.col(n).cast("string").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes])


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor(({part}) * 100 * {10**digits}::DOUBLE / ({whole}) + 0.5) / {10**digits} ELSE 0.0 END"


_BASE = """+ w AS (SELECT source_id, check_date, item_count, ok, tier0, list(CASE WHEN ok THEN item_count END) OVER (PARTITION BY source_id ORDER BY check_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS seen FROM checks),
g AS (SELECT *, list_sort(list_filter(seen, lambda x: x IS NOT NULL)) AS good, list_sort(list_filter(seen, lambda x: x > 0)) AS above FROM w),
b0 AS (SELECT *, good[CAST(floor(len(good) / 2) AS INT) + 1] AS typical, CASE WHEN len(above) >= 5 THEN greatest(1, CAST(floor(above[CAST(floor(len(above) * 0.1) AS INT) + 1] * 0.5) AS BIGINT)) END AS fl FROM g),
b AS (SELECT source_id, check_date, item_count, ok, tier0, typical, last_value(fl IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY check_date ROWS UNBOUNDED PRECEDING) AS minimum FROM b0)"""


@query("f3_learn_baselines", with_views(_BASE + " SELECT source_id, check_date::VARCHAR AS check_date, coalesce(typical, -1) AS typical, coalesce(minimum, -1) AS minimum FROM b", "checks"))
def learn_baselines(spark: SparkSession, d: str) -> DataFrame:
    return dated(A.learn_baselines(X.checks(spark, d)).fillna(-1, ["typical", "minimum"]))


@query("f4_pass_streak", with_views("""+ i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS island FROM ledger WHERE pass)
SELECT min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS days FROM i GROUP BY island""", "ledger"))
def pass_streak(spark: SparkSession, d: str) -> DataFrame:
    return dated(A.pass_streak(X.ledger(spark, d)))


_REFS = """+ m AS (SELECT r.*, EXISTS (SELECT 1 FROM detections x WHERE x.ref_id = r.ref_id) AS detected, CASE materiality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w FROM reference_events r)"""


@query("d11_match_references", with_views(_REFS + " SELECT ref_id, materiality, detected FROM m", "reference_events", "detections"))
def match_references(spark: SparkSession, d: str) -> DataFrame:
    return A.match_references(X.reference_events(spark, d), X.detections(spark, d))


@query("d11_false_positives", with_views("SELECT event_id, ref_id FROM detections WHERE ref_id NOT IN (SELECT ref_id FROM reference_events)", "reference_events", "detections"))
def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return A.false_positives(X.reference_events(spark, d), X.detections(spark, d))


def spelled(spark: SparkSession, d: str) -> DataFrame:
    """System events that name their references in five fields, with blanks and capitals."""
    k = F.col("o_orderkey")
    r = F.concat(F.lit("R"), k.cast("string"))
    none = F.lit(None).cast("string")
    return X.table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(
        k.alias("event_id"), F.when(k % 5 == 0, F.concat(F.lit(" "), r, F.lit(" "))).alias("reference_id"), F.when(k % 5 == 1, F.array(r, F.lower(r), none, F.lit(""))).alias("reference_ids"), F.when(k % 5 == 2, F.array(F.lit("  "), r)).alias("matches"),
        F.when(k % 5 == 3, r).alias("matched_reference_ids"), F.when(k % 11 == 0, F.array(F.lit("X-1"), r)).otherwise(F.array(none)).alias("benchmark_reference_ids"),
    )


_SPELLED = "+ n AS (SELECT o_orderkey AS event_id, 'r' || o_orderkey AS ref_id FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 5 < 4 OR o_orderkey % 11 = 0) UNION ALL SELECT o_orderkey, 'x-1' FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 = 0)"


@query("d11_reference_ids", "WITH" + _SPELLED.removeprefix("+") + " SELECT * FROM n")
def reference_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.reference_ids(spelled(spark, d))


@query("d11_match_spellings", with_views(_SPELLED + " SELECT 'R' || ref_id AS ref_id, EXISTS (SELECT 1 FROM n WHERE n.ref_id = 'r' || e.ref_id) AS detected FROM reference_events e", "reference_events"))
def match_spellings(spark: SparkSession, d: str) -> DataFrame:
    return A.match_references(X.reference_events(spark, d).select(F.concat(F.lit("R"), F.col("ref_id").cast("string")).alias("ref_id")), spelled(spark, d))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Ownership and leadership records from orders, with faults at known places."""
    k = F.col("o_orderkey")
    return X.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 30 == 0, "leadership").when(k % 70 == 0, "rumour").otherwise("ownership").alias("kind"), F.concat(F.lit("c"), (k % 40).cast("string")).alias("subject_id"),
        F.when(k % 30 != 0, (k % 110).cast("double")).alias("percentage"), F.col("o_orderdate").cast("date").alias("effective_from"), F.expr("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 70 - 10 AS INT))").alias("effective_to"),
        F.col("o_orderdate").cast("date").alias("as_of"), F.when(k % 200 == 0, k - 100).alias("previous_id"), (k % 60).alias("source_id"),
    )


_HISTORY = """hist AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 30 = 0 THEN 'leadership' WHEN o_orderkey % 70 = 0 THEN 'rumour' ELSE 'ownership' END AS kind, 'c' || o_orderkey % 40 AS subject_id,
 CASE WHEN o_orderkey % 30 <> 0 THEN (o_orderkey % 110)::DOUBLE END AS percentage, o_orderdate::DATE AS effective_from, o_orderdate::DATE + CAST(o_orderkey % 70 - 10 AS INT) AS effective_to,
 o_orderdate::DATE AS as_of, CASE WHEN o_orderkey % 200 = 0 THEN o_orderkey - 100 END AS previous_id, o_orderkey % 60 AS source_id FROM orders)"""


@query("l3_validity_view", f"WITH {_HISTORY} SELECT id, subject_id FROM hist WHERE effective_from <= DATE '1996-06-01' AND effective_to > DATE '1996-06-01'")
def validity_view(spark: SparkSession, d: str) -> DataFrame:
    return A.validity_view(history(spark, d), F.lit("1996-06-01").cast("date")).select("id", "subject_id")


def _coverage_inputs(spark: SparkSession, d: str):
    """Nations as entities; suppliers as sources, their labels holding a nation's name; every third refers to it by id."""
    key = F.col("n_nationkey")
    nations = X.table(spark, d, "nation").select(
        key.cast("string").alias("entity_id"), F.col("n_name").alias("name"), F.when(key % 2 == 0, "company").otherwise("person").alias("type"), (key % 5 == 0).alias("official_company"), (key % 7 == 1).alias("family"),
        (key % 6 == 1).alias("leader"), F.when(key % 3 == 0, F.concat(F.lit("https://example.com/Leadership/"), key.cast("string"))).alias("source_url"),
    )
    s = X.table(spark, d, "supplier").join(F.broadcast(X.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    refs = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.col("s_nationkey").cast("string"))).when(F.col("s_suppkey") % 20 == 1, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    label = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name")).otherwise(F.concat_ws(" ", "s_name", "n_name"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("registry", "official", "query", "authoritative")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    tier = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") % 2)
    return nations, s.select(F.col("s_suppkey").alias("source_id"), label.alias("label"), refs.alias("refs"), kind.alias("kind"), tier.alias("tier"))


_COVER = """WITH k AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 7 = 0 THEN s_name ELSE s_name || ' ' || n_name END AS label, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey::VARCHAR WHEN s_suppkey % 20 = 1 THEN 'none' END AS ref,
  ['registry', 'official', 'query', 'authoritative'][s_suppkey % 4 + 1] AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT *, CASE WHEN source_id % 5 = 0 THEN source_id % 2 WHEN kind IN ('official', 'authoritative') THEN 0 ELSE 3 END AS tier FROM k),
e AS (SELECT n_nationkey::VARCHAR AS entity_id, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS term, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'company' ELSE 'person' END AS type,
  CASE WHEN n_nationkey % 5 = 0 THEN 'official-company-register' WHEN n_nationkey % 7 = 1 THEN 'promoter-family' WHEN n_nationkey % 6 = 1 THEN 'significant-leader' WHEN n_nationkey % 2 = 1 AND n_nationkey % 3 = 0 THEN 'official-leadership-register' END AS priority_reason FROM nation),
mapped AS (SELECT entity_id, source_id, 1.0::DOUBLE AS confidence, 'reference' AS matched_by FROM s JOIN e ON ref = entity_id
UNION ALL SELECT entity_id, source_id, 0.65::DOUBLE, 'name' FROM s JOIN e ON ref IS NULL AND length(term) >= 5 AND contains(' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || term || ' ')),
p AS (SELECT entity_id, count(*) AS n, count(*) FILTER (tier = 0 OR kind IN ('official', 'authoritative')) AS dir, count(*) FILTER (kind = 'authoritative') AS aut, count(*) FILTER (kind = 'official') AS off, count(*) FILTER (kind IN ('query', 'registry')) AS dis,
  string_agg(DISTINCT matched_by, ',' ORDER BY matched_by) AS methods, string_agg(source_id::VARCHAR, ',' ORDER BY tier, label, source_id) AS sources FROM mapped JOIN s USING (source_id) GROUP BY entity_id),
cov AS (SELECT entity_id, name, type, priority_reason IS NOT NULL AS priority, priority_reason, CASE WHEN dir > 0 AND dis > 0 THEN 'covered' WHEN n > 0 AND (dir > 0 OR dis > 0) THEN 'partial' ELSE 'gap' END AS status,
  coalesce(n, 0) AS n_sources, coalesce(dir, 0) AS direct, coalesce(aut, 0) AS authoritative, coalesce(off, 0) AS official, coalesce(dis, 0) AS discovery, coalesce(methods, '') AS methods, coalesce(sources, '') AS sources,
  concat_ws(',', CASE WHEN coalesce(dir, 0) = 0 THEN 'no-direct-tier-0-source' END, CASE WHEN coalesce(dis, 0) = 0 THEN 'no-discovery-or-media-map' END, CASE WHEN priority_reason IS NOT NULL AND coalesce(aut, 0) = 0 AND type = 'company' THEN 'no-direct-authoritative-adapter' END) AS gaps
  FROM e LEFT JOIN p USING (entity_id))"""


@query("d6_map_sources", _COVER + " SELECT * FROM mapped")
def map_sources(spark: SparkSession, d: str) -> DataFrame:
    return A.map_sources(*_coverage_inputs(spark, d))


@query("d6_unresolved_references", _COVER + " SELECT source_id, ref AS entity_id FROM s WHERE ref = 'none'")
def unresolved(spark: SparkSession, d: str) -> DataFrame:
    return A.unresolved_references(*_coverage_inputs(spark, d))


@query("e14_entity_source_coverage", _COVER + " SELECT * FROM cov")
def entity_source_coverage(spark: SparkSession, d: str) -> DataFrame:
    e, s = _coverage_inputs(spark, d)
    return A.entity_source_coverage(e, A.map_sources(e, s), s)


_STATES = ", ".join([f"count(*) FILTER (status = '{s}') AS {s}" for s in ("covered", "partial", "gap")] + [f"count(*) FILTER (priority AND status = '{s}') AS priority_{s}" for s in ("covered", "partial", "gap")])


@query("e13_coverage_summary", _COVER + f""", r AS (SELECT count(*) AS entities, count(*) FILTER (priority) AS priority, {_STATES}, (SELECT count(*) FROM s) AS sources, (SELECT count(*) FROM mapped) AS mappings, (SELECT count(*) FROM s WHERE ref = 'none') AS unresolved FROM cov)
SELECT *, {pct("priority_covered", "priority", 1)} AS percent FROM r""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    e, s = _coverage_inputs(spark, d)
    return A.coverage_summary(entity_source_coverage(spark, d), A.map_sources(e, s), s, A.unresolved_references(e, s))


@query("c10_filter_coverage", _COVER + " SELECT entity_id, n_sources FROM cov WHERE status = 'partial' AND type = 'person' AND priority AND contains(gaps, 'no-direct-tier-0-source') AND contains(lower(name || ' ' || entity_id), 'a') UNION ALL SELECT entity_id, n_sources FROM cov WHERE status = 'covered' AND type = 'company'")
def filter_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = entity_source_coverage(spark, d)
    lacking = A.filter_coverage(rows, "partial", type="person", priority=True, gap="no-direct-tier-0-source", search=" A ")
    return lacking.union(A.filter_coverage(rows, "covered", type="company")).select("entity_id", "n_sources")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each day of events as a run: when it was taken in and the span it covers."""
    e = X.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    stamp = F.expr("timestampadd(MINUTE, CAST(n % 97 AS INT), CAST(day AS TIMESTAMP))")
    return e.select(F.date_format("day", "yyyyMMdd").alias("run_id"), stamp.alias("ingested_at"), F.col("day").cast("timestamp").alias("window_start"), stamp.alias("window_end"), "n")


_RUN_SQL = "runs AS (SELECT strftime(day, '%Y%m%d') AS run_id, day::TIMESTAMP + to_minutes(CAST(n % 97 AS INT)) AS ingested_at, day::TIMESTAMP AS window_start, day::TIMESTAMP + to_minutes(CAST(n % 97 AS INT)) AS window_end, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1))"


@query("c16_freshness_verdict", f"""WITH {_RUN_SQL} SELECT run_id, CAST(greatest(0, floor((epoch_ms(TIMESTAMP '2024-01-16 00:30:00') - epoch_ms(ingested_at)) / 60000)) AS BIGINT) AS age_minutes,
CASE WHEN epoch_ms(TIMESTAMP '2024-01-16 00:30:00') - epoch_ms(ingested_at) < -60000 THEN 'future' WHEN epoch_ms(TIMESTAMP '2024-01-16 00:30:00') - epoch_ms(ingested_at) > 180 * 60000 THEN 'stale' ELSE 'fresh' END AS verdict FROM runs""")
def freshness_verdict(spark: SparkSession, d: str) -> DataFrame:
    return A.freshness_verdict(_runs(spark, d), "ingested_at", 180, F.lit("2024-01-16 00:30:00").cast("timestamp")).select("run_id", "age_minutes", "verdict")


@query("c15_coverage_policy", f"""WITH {_RUN_SQL}, l AS (SELECT run_id, CAST(greatest(0, ceil((epoch_ms(TIMESTAMP '2024-01-16 00:30:00') - epoch_ms(window_end)) / 60000)) AS BIGINT) AS lag_minutes FROM runs)
SELECT *, CASE WHEN lag_minutes = 0 THEN 'complete' WHEN lag_minutes <= 90 THEN 'trailing' ELSE 'incomplete' END AS coverage FROM l""")
def coverage_policy(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage_policy(_runs(spark, d), F.lit("2024-01-16 00:30:00").cast("timestamp")).select("run_id", "lag_minutes", "coverage")


@query("f5_latest_run", f"WITH {_RUN_SQL} SELECT run_id, n FROM runs ORDER BY ingested_at DESC, run_id DESC LIMIT 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_run(_runs(spark, d)).select("run_id", "n")


_OUT = " UNION ALL ".join(f"SELECT '{c}_range' AS rule, event_id FROM told WHERE {c} NOT BETWEEN 0 AND 100" for c in ("materiality", "certainty", "momentum", "narrative_alignment"))


@query("e28_quality_rules", with_views(f"""SELECT 'unknown_entity' AS rule, event_id FROM told WHERE entity_id = 'e8' UNION ALL SELECT 'unknown_entity', event_id FROM told WHERE event_id % 2 = 1 UNION ALL {_OUT}
UNION ALL SELECT 'summary_length', event_id FROM told WHERE len(string_split_regex(trim(summary), '\\s+')) NOT BETWEEN 60 AND 100 UNION ALL SELECT 'headline_missing', event_id FROM told WHERE headline = '' UNION ALL SELECT 'summary_missing', event_id FROM told WHERE summary = ''
UNION ALL SELECT 'category_missing', event_id FROM told WHERE category IS NULL UNION ALL SELECT 'no_source', event_id FROM told WHERE bare UNION ALL SELECT 'source_address', event_id FROM told WHERE NOT bare AND event_id % 31 = 0
UNION ALL SELECT 'status', event_id FROM told WHERE event_id % 41 = 0 UNION ALL SELECT 'tone_range', event_id FROM told WHERE tone + 1 > 100""", "served", "told"))
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Events with an entity of their own and x0 or x1; e8 and x1 are unknown, some have a status and a tone that they may not have."""
    e = X.told(spark, d).withColumns({"status": F.when(F.col("event_id") % 41 == 0, "none").otherwise(F.col("status")), "tone": F.col("tone") + 1})
    return A.quality_rules(e, e.filter("entity_id <> 'e8'").select("entity_id").distinct().union(spark.createDataFrame([("x0",)], "entity_id string")))
