"""Queries over validation, coverage, health, registries and search, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine import fixtures as X
from evidence_engine.fixtures import LEXICON, with_views
from evidence_engine.operators import audits as A
from evidence_engine.operators import coverage as C
from evidence_engine.operators import health as H
from evidence_engine.operators import registry as R
from evidence_engine.operators import search as S
from evidence_engine.operators import validation as V
from evidence_engine.operators.articles import match_entities
from evidence_engine.queries import sqltext as T
from evidence_engine.queries.audit import dated, pct

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Validation.


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """Stored events as they might come in: some without id, summary or source, some with unknown buckets."""
    k = F.col("event_id")
    source = F.array(F.struct(F.when(k % 17 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://"), F.coalesce("source", F.lit("s")))).alias("url")))
    return X.served(spark, d).select(
        k.alias("ord"), (k % 7).alias("call"), F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("e"), k.cast("string"))).alias("event_id"), "headline", F.when(k % 11 == 0, "").otherwise(F.col("bucket")).alias("summary"), F.lit("w").alias("why"),
        F.when(k % 13 == 0, "none").otherwise(F.col("bucket")).alias("bucket"), "status", F.when(k % 19 == 0, F.array().cast("array<struct<url:string>>")).otherwise(source).alias("sources"),
    )


@query(
    "c7_validate_events",
    with_views(
        """+ v AS (SELECT event_id AS ord, event_id % 7 AS call, concat_ws(',', CASE WHEN event_id % 50 = 0 THEN 'event_id_missing' END, CASE WHEN coalesce(headline, '') = '' THEN 'headline_missing' END, CASE WHEN event_id % 11 = 0 THEN 'summary_missing' END,
  CASE WHEN event_id % 13 = 0 THEN 'bucket' END, CASE WHEN event_id % 19 = 0 THEN 'no_source' END, CASE WHEN event_id % 17 = 0 AND event_id % 19 <> 0 THEN 'unsafe_source' END) AS problems FROM served),
n AS (SELECT *, sum(CASE WHEN problems = '' THEN 1 ELSE 0 END) OVER (PARTITION BY call ORDER BY ord ROWS UNBOUNDED PRECEDING) AS nth FROM v)
SELECT ord, problems, CASE WHEN problems <> '' THEN 'rejected' WHEN nth > 20 THEN 'over_limit' ELSE 'accepted' END AS verdict FROM n""",
        "served",
    ),
)
def validate_events(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_events(_incoming(spark, d), "call", "ord", 20).select("ord", F.array_join("problems", ",").alias("problems"), "verdict")


@query(
    "c8_validate_observations",
    with_views(
        """+ v AS (SELECT obs_id, tone_score, engagement_count, concat_ws(',', CASE WHEN obs_id % 19 = 0 THEN 'platform_missing' END, CASE WHEN obs_id % 23 = 0 THEN 'unsafe_address' END, CASE WHEN obs_id % 29 = 0 OR obs_id % 31 = 0 THEN 'tone' END,
  CASE WHEN obs_id % 37 = 0 THEN 'engagement' END, CASE WHEN obs_id % 43 = 0 THEN 'date' END) AS problems FROM observations)
SELECT obs_id, problems, CASE WHEN problems = '' THEN 'accepted' ELSE 'rejected' END AS verdict FROM v""",
        "observations",
    ),
)
def validate_observations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("obs_id")
    rows = X.observations(spark, d).select(
        "obs_id", F.col("event_key").alias("event_id"), F.when(k % 19 == 0, "").otherwise(F.col("platform")).alias("platform"), F.when(k % 23 == 0, "ftp://x").otherwise(F.concat(F.lit("https://p.example.com/"), k.cast("string"))).alias("source_url"),
        F.when(k % 29 == 0, "high").when(k % 31 == 0, "250").otherwise(F.col("tone_score").cast("string")).alias("tone_score"), F.when(k % 37 == 0, "-5").when(k % 41 == 0, "").otherwise(F.col("engagement_count").cast("string")).alias("engagement_count"),
        F.when(k % 43 == 0, "soon").otherwise(F.col("published_at").cast("string")).alias("published_at"),
    )
    return V.validate_observations(rows).select("obs_id", F.array_join("problems", ",").alias("problems"), "verdict")


@query("b26_event_materiality", with_views("SELECT event_id, (CASE event_id % 4 WHEN 0 THEN materiality WHEN 1 THEN 100 WHEN 2 THEN least(certainty, 100) ELSE 0 END)::DOUBLE AS value FROM served", "served"))
def event_materiality(spark: SparkSession, d: str) -> DataFrame:
    k, m, c = F.col("event_id") % 4, F.col("materiality").cast("string"), F.col("certainty").cast("string")
    paths = [F.when(k == 0, m).when(k == 1, "150").when(k == 2, "x"), F.when(k == 2, "Infinity").when(k == 3, "-7"), F.when(k == 2, c), F.lit("1")]
    return X.served(spark, d).select("event_id", V.event_materiality(*paths).alias("value"))


# Coverage of entities by sources and queries.


def _governed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as entities, suppliers as sources and as discovery queries."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    nation = X.table(spark, d, "nation")
    none = F.lit(None).cast("string")
    entities = nation.select(
        F.concat(F.lit("n"), k.cast("string")).alias("entity_id"), F.col("n_name").alias("name"), F.element_at(F.array(*[F.lit(t) for t in ("company", "person", "brand", "group")]), (k % 4 + 1).cast("int")).alias("type"),
        F.array().cast("array<string>").alias("terms"), F.lit(None).cast("boolean").alias("active"), F.lit(True).alias("monitor"), F.when(k % 10 == 7, "exclude").when(k % 5 == 0, "high").alias("priority"), none.alias("role_tier"),
        (k % 3 == 0).alias("official_company"), (k % 8 == 1).alias("official_leader"), F.when(k % 2 == 0, "2020-01-01").alias("effective_from"), F.when(k % 8 == 0, "x").alias("jurisdiction"),
    )
    supplier = X.table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == k)
    scope = F.when(s % 3 == 0, F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    domain = F.concat(F.lit("s"), s.cast("string"), F.lit(".example.com"))
    sources = supplier.select(
        s.alias("source_id"), F.col("s_name").alias("name"), F.when(s % 7 == 0, "").otherwise(F.col("n_name")).alias("label"), F.concat(F.lit("https://"), domain).alias("url"), domain.alias("domain"),
        F.element_at(F.array(F.lit("newsroom"), F.lit("media"), F.lit("Exchange filing"), none, F.lit("blog")), (s % 5 + 1).cast("int")).alias("kind"), F.when(s % 4 == 0, "tier 0").when(s % 4 == 2, "tier 2").alias("tier"),
        F.lit(None).cast("boolean").alias("direct"), (s % 20 == 0).alias("official"), F.lit(False).alias("registry"), F.lit(False).alias("authoritative"), F.when(s % 6 == 0, "").otherwise("licensed").alias("rights"), F.when(s % 9 != 0, "daily").alias("cadence"), scope.alias("scope"),
    )
    ask = F.when(s % 4 == 0, F.concat(F.lit("news "), F.col("n_name"))).otherwise("market")
    queries = supplier.select(F.concat(F.lit("q"), s.cast("string")).alias("query_id"), F.lit("").alias("label"), ask.alias("query"), F.lit("").alias("description"), F.array().cast("array<string>").alias("scope"))
    return entities, sources, queries


def _words(x: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')) || ' ')"


_GOVERNED = f"""WITH n AS (SELECT *, n_nationkey AS k FROM nation),
e AS (SELECT 'n' || k AS entity_id, n_name AS name, ['company', 'person', 'brand', 'group'][k % 4 + 1] AS type, k % 4 = 0 AND k % 3 = 0 AS official_company, k % 4 = 1 AND (k % 8 = 1 OR k % 5 = 0) AS leader, k % 2 = 0 AS dated, k % 8 = 0 AS placed FROM n WHERE k % 10 <> 7),
s AS (SELECT s_suppkey AS source_id, {_words("s_suppkey || ' ' || s_name || ' ' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE n_name END || ' https://s' || s_suppkey || '.example.com'")} AS corpus, CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_nationkey END AS scope,
  s_suppkey % 20 = 0 OR s_suppkey % 5 IN (0, 2) AS direct, s_suppkey % 20 = 0 OR s_suppkey % 4 = 0 OR (s_suppkey % 4 IN (1, 3) AND s_suppkey % 5 = 2) AS authoritative, s_suppkey % 6 <> 0 AS rights, s_suppkey % 9 <> 0 AS operational,
  CASE WHEN s_suppkey % 4 = 0 THEN {_words("'news ' || n_name")} ELSE ' market ' END AS ask FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT entity_id, source_id, direct, authoritative FROM e JOIN s ON contains(corpus, {_words("name")}) OR scope = entity_id),
q AS (SELECT entity_id, 'q' || source_id AS query_id FROM e JOIN s ON contains(ask, {_words("name")})),
r AS (SELECT e.*, coalesce((SELECT string_agg(source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FROM m WHERE m.entity_id = e.entity_id AND direct), '') AS direct_ids,
  coalesce((SELECT string_agg(source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FROM m WHERE m.entity_id = e.entity_id AND authoritative), '') AS authoritative_ids,
  coalesce((SELECT string_agg(query_id, ',' ORDER BY query_id) FROM q WHERE q.entity_id = e.entity_id), '') AS query_ids FROM e)"""


@query("d7_coverage_matches", _GOVERNED + " SELECT entity_id, source_id AS corpus_id FROM m")
def coverage_matches(spark: SparkSession, d: str) -> DataFrame:
    entities, sources, _ = _governed(spark, d)
    ask = entities.filter("coalesce(priority, '') <> 'exclude'").select("entity_id", F.array("name").alias("terms"))
    return C.coverage_matches(ask, sources.select(F.col("source_id").alias("corpus_id"), F.concat_ws(" ", F.col("source_id").cast("string"), "name", "label", "url").alias("corpus"), "scope"))


@query("e13_coverage_rows", _GOVERNED + """ SELECT entity_id, name, type, official_company, leader, direct_ids, authoritative_ids, query_ids, concat_ws(',', CASE WHEN direct_ids = '' THEN 'no_direct_source' END, CASE WHEN authoritative_ids = '' THEN 'no_authoritative_source' END,
CASE WHEN query_ids = '' THEN 'no_discovery_query' END, CASE WHEN type = 'person' AND NOT dated THEN 'role_effective_date_missing' END, CASE WHEN type = 'company' AND NOT placed THEN 'jurisdiction_missing' END) AS issues, direct_ids <> '' AND query_ids <> '' AS covered FROM r""")
def coverage_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_rows(*_governed(spark, d))


@query("e13_coverage_audit", _GOVERNED + f""", a AS (SELECT count(*) AS entities, count(*) FILTER (direct_ids <> '' AND query_ids <> '') AS covered, count(*) FILTER (direct_ids <> '') AS direct_covered, count(*) FILTER (query_ids <> '') AS discovery_covered,
  count(*) FILTER (official_company) AS companies, count(*) FILTER (official_company AND direct_ids <> '') AS companies_direct, count(*) FILTER (leader) AS leaders, count(*) FILTER (leader AND direct_ids <> '') AS leaders_direct FROM r),
b AS (SELECT count(*) AS sources, count(*) FILTER (direct) AS direct_sources, count(*) FILTER (authoritative) AS authoritative_sources, count(*) FILTER (rights) AS rights_governed, count(*) FILTER (operational) AS operational, count(*) FILTER (direct AND operational) AS direct_operational FROM s)
SELECT *, {pct("covered", "entities")} AS covered_pct, {pct("direct_covered", "entities")} AS direct_pct, {pct("discovery_covered", "entities")} AS discovery_pct, {pct("companies_direct", "companies")} AS companies_pct, {pct("leaders_direct", "leaders")} AS leaders_pct,
  companies > 0 AND companies_direct = companies AS gate_companies, leaders > 0 AND leaders_direct = leaders AS gate_leaders, entities > 0 AND discovery_covered = entities AS gate_discovery, sources > 0 AND rights_governed = sources AS gate_rights, direct_operational = direct_sources AS gate_operational FROM a, b""")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_audit(coverage_rows(spark, d), _governed(spark, d)[1])


@query("e13_coverage_gap_lists", _GOVERNED + """ SELECT 'no_direct_source' AS gap, entity_id AS id FROM r WHERE direct_ids = '' UNION ALL SELECT 'no_authoritative_source', entity_id FROM r WHERE authoritative_ids = '' UNION ALL SELECT 'no_discovery_query', entity_id FROM r WHERE query_ids = ''
UNION ALL SELECT 'no_rights_status', source_id::VARCHAR FROM s WHERE NOT rights UNION ALL SELECT 'no_operational_metadata', source_id::VARCHAR FROM s WHERE direct AND NOT operational""")
def coverage_gap_lists(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_gap_lists(coverage_rows(spark, d), _governed(spark, d)[1])


@query("g12_coverage_order", _GOVERNED + """ SELECT CAST(row_number() OVER (ORDER BY priority DESC, status, name, entity_id) AS INT) AS rank, * FROM (SELECT entity_id, name, official_company OR leader AS priority,
CASE WHEN direct_ids <> '' AND query_ids <> '' THEN 'covered' WHEN direct_ids <> '' OR query_ids <> '' THEN 'partial' ELSE 'gap' END AS status FROM r) ORDER BY priority DESC, status, name, entity_id LIMIT 10""")
def coverage_order(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("covered"), "covered").when((F.col("direct_ids") != "") | (F.col("query_ids") != ""), "partial").otherwise("gap")
    rows = coverage_rows(spark, d).select("entity_id", "name", (F.col("official_company") | F.col("leader")).alias("priority"), status.alias("status"))
    return C.coverage_order(rows, 10)


# Source health.


def _health_checks(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and day as a check of a source, with status, latency and the state of its registry."""
    day, error = F.to_date("ts").alias("check_date"), F.count_if(F.col("event_type") == "error")
    n = F.count(F.lit(1))
    rows = X.table(spark, d, "events").groupBy(F.col("user_id").alias("source_id"), day).agg((n - error).alias("item_count"), (error < n).alias("ok"), F.when((error < n) & (error * 3 > n), "degraded").alias("status"), n.alias("n"))
    k = F.col("source_id")
    return rows.withColumns({"latency_ms": F.when(k % 6 != 0, (F.col("n") * 10).cast("double")), "reconciled": (k + F.dayofmonth("check_date")) % 13 != 0, "tier0": k % 10 == 0, "reviewed": k % 4 != 0}).drop("n")


_HEALTH = """WITH hc AS (SELECT user_id AS source_id, CAST(ts AS DATE) AS check_date, count(*) FILTER (event_type <> 'error') AS item_count, count(*) FILTER (event_type = 'error') < count(*) AS ok,
  count(*) FILTER (event_type = 'error') < count(*) AND count(*) FILTER (event_type = 'error') * 3 > count(*) AS degr, user_id % 6 <> 0 AS measured, user_id % 10 = 0 AS tier0, user_id % 4 <> 0 AS reviewed FROM events GROUP BY user_id, CAST(ts AS DATE)),
w AS (SELECT *, (source_id + day(check_date)) % 13 = 0 AS drifted, list(CASE WHEN ok THEN item_count END) OVER (PARTITION BY source_id ORDER BY check_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS seen FROM hc),
g AS (SELECT *, list_sort(list_filter(seen, lambda x: x IS NOT NULL)) AS good, list_sort(list_filter(seen, lambda x: x > 0)) AS above FROM w),
b0 AS (SELECT *, coalesce(good[CAST(floor(len(good) / 2) AS INT) + 1], 0) AS typical, CASE WHEN len(above) >= 5 THEN greatest(1, CAST(floor(above[CAST(floor(len(above) * 0.1) AS INT) + 1] * 0.5) AS BIGINT)) END AS fl FROM g),
b AS (SELECT *, coalesce(last_value(fl IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY check_date ROWS UNBOUNDED PRECEDING), 0) AS minimum FROM b0),
c AS (SELECT *, ok AND minimum > 0 AND item_count < minimum AS below, ok AND typical > 0 AND item_count < greatest(minimum, typical * 0.2) AS fell FROM b),
h AS (SELECT source_id, check_date, tier0, item_count, CASE WHEN degr THEN 'degraded' WHEN NOT ok THEN 'failed' ELSE 'healthy' END AS reported, minimum AS expected_minimum, typical AS expected_typical, NOT ok AS explicit_failure, below OR fell OR drifted AS silent_failure,
  ok AND NOT (below OR fell OR drifted) AND NOT degr AS healthy, concat_ws(',', CASE WHEN NOT ok THEN 'request_failed' END, CASE WHEN degr THEN 'provider_degraded' END, CASE WHEN below THEN 'below_minimum_volume' END, CASE WHEN fell THEN 'severe_volume_drop' END,
  CASE WHEN drifted THEN 'registry_drift' END, CASE WHEN NOT measured THEN 'latency_unmeasured' END, CASE WHEN NOT reviewed THEN 'baseline_unreviewed' END) AS issues FROM c)"""


def _health(spark: SparkSession, d: str) -> DataFrame:
    checks = _health_checks(spark, d)
    return H.source_health(checks, A.learn_baselines(checks))


@query("e16_source_health", _HEALTH + " SELECT * REPLACE (check_date::VARCHAR AS check_date) FROM h")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return dated(_health(spark, d))


@query("e16_health_summary", _HEALTH + f""", s AS (SELECT check_date, count(*) AS checks, count(*) FILTER (healthy) AS healthy, count(*) FILTER (reported = 'degraded') AS degraded, count(*) FILTER (explicit_failure) AS explicit_failures, count(*) FILTER (silent_failure) AS silent_failures,
  count(*) FILTER (expected_minimum > 0 OR expected_typical > 0) AS baseline_coverage, count(*) FILTER (explicit_failure AND tier0) AS tier0_explicit, count(*) FILTER (silent_failure AND tier0) AS tier0_silent FROM h GROUP BY check_date)
SELECT * REPLACE (check_date::VARCHAR AS check_date), {pct("healthy", "checks", 2)} AS success_pct, {pct("baseline_coverage", "checks", 2)} AS baseline_pct, tier0_explicit = 0 AS gate_tier0_explicit, tier0_silent = 0 AS gate_tier0_silent, {pct("healthy", "checks", 2)} >= 90 AS gate_success, baseline_coverage = checks AS gate_baselines FROM s""")
def health_summary(spark: SparkSession, d: str) -> DataFrame:
    return dated(H.health_summary(_health(spark, d)))


@query("e26_tier_health", _HEALTH + " SELECT tier0, count(DISTINCT source_id) AS sources, count(*) FILTER (explicit_failure) AS failed, count(*) FILTER (silent_failure) AS silent FROM h GROUP BY tier0")
def tier_health(spark: SparkSession, d: str) -> DataFrame:
    return H.tier_health(_health(spark, d))


# Registries.


def _registries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as expected; observed with other names but a common alias, other or no titles, two records of one name, some gone, some new."""
    k, role = F.col("s_suppkey"), F.concat(F.lit("role"), F.col("s_nationkey").cast("string"))
    s, text = X.table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    alias, none = F.array(F.concat(F.lit("Alias & "), text)), F.array().cast("array<string>")
    expected = s.select(F.concat(F.lit("s"), text).alias("id"), F.col("s_name").alias("name"), F.when(k % 13 != 0, role).alias("title"), alias.alias("aliases"))
    moved = F.concat(F.lit("role"), F.when(k % 11 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).cast("string"))
    main = s.filter(k % 17 != 0).select(F.concat(F.lit("o"), text).alias("id"), F.when(k % 5 == 0, F.concat(F.lit("Other "), text)).otherwise(F.concat("s_name", F.lit(" Ltd"))).alias("name"), moved.alias("title"), F.when(k % 5 == 0, alias).otherwise(none).alias("aliases"))
    twin = s.filter(k % 7 == 0).select(F.concat(F.lit("p"), text).alias("id"), F.concat("s_name", F.lit(" Inc")).alias("name"), F.lit("roleX").alias("title"), none.alias("aliases"))
    new = X.table(spark, d, "nation").select(F.concat(F.lit("z"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("New "), "n_name").alias("name"), F.lit(None).cast("string").alias("title"), none.alias("aliases"))
    return expected, main.union(twin).union(new)


_REGISTRIES = """WITH e AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 13 <> 0 THEN 'role' || s_nationkey END AS title FROM supplier),
o AS (SELECT s_suppkey AS k, 'o' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'Other ' || s_suppkey ELSE s_name || ' Ltd' END AS name, 'role' || CASE WHEN s_suppkey % 11 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS title, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS pos FROM supplier WHERE s_suppkey % 17 <> 0
  UNION ALL SELECT s_suppkey, 'p' || s_suppkey, s_name || ' Inc', 'roleX', 1 FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT -1, 'z' || n_nationkey, 'New ' || n_name, NULL, 0 FROM nation),
j AS (SELECT e.*, o.id AS oid, o.title AS ot, row_number() OVER (PARTITION BY e.id ORDER BY coalesce(e.title = o.title, false) DESC, pos, o.id) AS n FROM e LEFT JOIN o ON o.k = e.k),
diff AS (SELECT CASE WHEN oid IS NULL THEN 'removal' WHEN title IS NOT NULL AND title <> ot THEN 'role_change' ELSE 'unchanged' END AS change, id, name, title AS from_title, ot AS to_title FROM j WHERE n = 1
  UNION ALL SELECT 'addition', id, name, NULL, title FROM o WHERE id NOT IN (SELECT oid FROM j WHERE n = 1 AND oid IS NOT NULL))"""


@query("d10_registry_diff", _REGISTRIES + " SELECT * FROM diff")
def registry_diff(spark: SparkSession, d: str) -> DataFrame:
    return R.registry_diff(*_registries(spark, d))


@query("d10_registry_summary", _REGISTRIES + """ SELECT count(*) FILTER (change = 'addition') AS addition, count(*) FILTER (change = 'removal') AS removal, count(*) FILTER (change = 'role_change') AS role_change, count(*) FILTER (change = 'unchanged') AS unchanged,
count(*) FILTER (change = 'ambiguous') AS ambiguous, count(*) FILTER (change <> 'unchanged') = 0 AS reconciled FROM diff""")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.registry_summary(registry_diff(spark, d))


@query("l2_effective_date_suggestions", _REGISTRIES + " SELECT CASE change WHEN 'addition' THEN 'add' WHEN 'removal' THEN 'close' ELSE 'change_role' END AS action, id, '2024-01-31' AS effective FROM diff WHERE change <> 'unchanged'")
def effective_dates(spark: SparkSession, d: str) -> DataFrame:
    return dated(A.effective_date_suggestions(registry_diff(spark, d), "2024-01-31"))


# Search and answers.


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored events with a category and the entities that they are about."""
    k = F.col("event_id")
    ids = F.array(*[F.lit(e[0]) for e in X.ENTITIES])
    return X.served(spark, d).withColumn("category", F.when(k % 3 == 0, "Reputation").otherwise("Corporate")).withColumn("entity_ids", F.array(F.element_at(ids, (k % len(X.ENTITIES) + 1).cast("int"))))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Queries drawn from the table: of every hundredth event the first four words of its headline, or a question of a kind, and a facet."""
    k = F.col("event_id") / 100
    words = F.array_join(F.slice(F.split("headline", " "), 1, 4), " ")
    text = F.when(k % 6 == 1, "What must know is there today?").when(k % 6 == 2, "Any narrative drift?").when(k % 6 == 3, "What remains?").when(k % 6 == 4, "Good news").otherwise(words)
    facet = F.when(k % 5 == 1, "must").when(k % 5 == 2, "confirmed").when(k % 5 == 3, "Reputation").otherwise("all")
    return X.served(spark, d).filter("event_id % 100 = 0").select(F.col("event_id").alias("qid"), text.alias("text"), words.alias("words"), facet.alias("facet"))


_IDS = T.listed(e[0] for e in X.ENTITIES)
_ASKED = f"""+ sv AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'Reputation' ELSE 'Corporate' END AS category, {_IDS}[event_id % {len(X.ENTITIES)} + 1] AS entity FROM served),
qs AS (SELECT event_id AS ord, array_to_string(list_slice(string_split(headline, ' '), 1, 4), ' ') AS words, CASE event_id // 100 % 5 WHEN 1 THEN 'must' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'Reputation' ELSE 'all' END AS facet,
  CASE event_id // 100 % 6 WHEN 1 THEN 'must' WHEN 2 THEN 'narrative' WHEN 3 THEN 'unconfirmed' WHEN 4 THEN 'positive' ELSE 'words' END AS intent FROM served WHERE event_id % 100 = 0),
tx AS (SELECT *, {T.normalized("headline || ' ' || category")} AS body, {T.tokens("headline || ' ' || category")} AS tokens FROM sv),
qt AS (SELECT *, {T.normalized("words")} AS q, {T.tokens("words")} AS tokens FROM qs)"""


@query("j1_search", with_views(_ASKED + """ SELECT ord AS qid, event_id FROM qt JOIN tx ON (contains(body, q) OR len(list_intersect(qt.tokens, tx.tokens)) >= greatest(1, ceil(len(qt.tokens) * 0.5)))
AND CASE facet WHEN 'all' THEN true WHEN 'must' THEN bucket = 'must' WHEN 'confirmed' THEN status = 'confirmed' ELSE category = facet END""", "served"))
def search(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_questions(spark, d).select("qid", F.col("words").alias("text"), "facet"), _stored(spark, d), LEXICON)


@query("j2_answer", with_views(_ASKED + f""", {T.matches("mq", "qs", "words")},
must AS (SELECT 'must' AS intent, event_id, row_number() OVER (ORDER BY materiality DESC, updated_at DESC, event_id) AS rank FROM sv WHERE bucket = 'must'),
narr AS (SELECT 'narrative', event_id, row_number() OVER (ORDER BY CASE WHEN drift >= 35 THEN drift ELSE 0 END DESC, event_id) FROM sv WHERE drift >= 35 OR category = 'Reputation'),
unco AS (SELECT 'unconfirmed', event_id, row_number() OVER (ORDER BY materiality DESC, event_id) FROM sv WHERE status <> 'confirmed'),
posi AS (SELECT 'positive', event_id, row_number() OVER (ORDER BY tone DESC, event_id) FROM sv WHERE tone > 20),
kinds AS (SELECT * FROM must WHERE rank <= 4 UNION ALL SELECT * FROM narr WHERE #3 <= 4 UNION ALL SELECT * FROM unco WHERE #3 <= 5 UNION ALL SELECT * FROM posi WHERE #3 <= 5),
sc AS (SELECT qt.ord AS qid, event_id, materiality, len(list_intersect(qt.tokens, tx.tokens)) + 4 * (SELECT count(*) FROM mq WHERE mq.ord = qt.ord AND mq.entity_id = tx.entity) AS score FROM qt, tx WHERE intent = 'words'),
rk AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, materiality DESC, event_id) AS INT) AS rank, event_id, score FROM sc WHERE score > 0)
SELECT ord AS qid, CAST(rank AS INT) AS rank, event_id, 0 AS score FROM qs JOIN kinds USING (intent) UNION ALL SELECT * FROM rk WHERE rank <= 5""".replace("FROM narr WHERE #3", "FROM narr n(intent, event_id, rank) WHERE rank").replace("FROM unco WHERE #3", "FROM unco u(intent, event_id, rank) WHERE rank").replace("FROM posi WHERE #3", "FROM posi p(intent, event_id, rank) WHERE rank"), "served"))
def answer(spark: SparkSession, d: str) -> DataFrame:
    asked = _questions(spark, d)
    mentions = match_entities(asked.select(F.col("qid").alias("ord"), F.col("words").alias("text")), X.entities(spark), LEXICON).select(F.col("ord").alias("qid"), "entity_id")
    return S.answer(asked.select("qid", "text"), _stored(spark, d), mentions, LEXICON)


@query("j2_answer_links", f"""WITH a AS ({ORACLES["j2_answer"]}), e AS (SELECT doc_id AS event_id, source FROM documents),
t AS (SELECT qid, rank, 0 AS nth, 'https://' || source || '.example.com/a' AS url, 'by source' AS name FROM a JOIN e USING (event_id) UNION ALL SELECT qid, rank, 1, 'https://e' || event_id || '.example.com/', 'own' FROM a),
f AS (SELECT qid, url, min(rank * 10 + nth) AS first, arg_min(name, rank * 10 + nth) AS name FROM t GROUP BY qid, url)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INT) AS place, url, name FROM f""")
def answer_links(spark: SparkSession, d: str) -> DataFrame:
    """Each event has one source that it shares with others and one of its own."""
    shared = F.struct(F.concat(F.lit("https://"), "source", F.lit(".example.com/a")).alias("url"), F.lit("by source").alias("name"))
    own = F.struct(F.concat(F.lit("https://e"), F.col("event_id").cast("string"), F.lit(".example.com/")).alias("url"), F.lit("own").alias("name"))
    return S.answer_links(answer(spark, d), X.served(spark, d).select("event_id", F.array(shared, own).alias("sources")))


@query("g11_latest_decisions", with_views("""SELECT event_id, updated_at AS at, CASE bucket WHEN 'must' THEN 'Must know' WHEN 'watch' THEN 'Watch' ELSE 'Other' END || ': ' || headline AS decision, source_count || CASE WHEN source_count = 1 THEN ' source' ELSE ' sources' END || ' · certainty ' || certainty AS basis,
CASE WHEN status = 'confirmed' THEN 'Published' ELSE 'Labelled' END AS outcome FROM served ORDER BY updated_at DESC, event_id LIMIT 8""", "served"))
def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_decisions(X.served(spark, d))
