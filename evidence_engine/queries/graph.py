"""Queries over claims and evidence, with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine import fixtures as X
from evidence_engine.fixtures import with_views
from evidence_engine.operators import claims as C
from evidence_engine.operators.events import stored_rows
from evidence_engine.operators.validation import validate_events
from evidence_engine.plans.materialize import materialize
from evidence_engine.plans.merge import ingest_gate, merge_table, upsert_claim_graph
from evidence_engine.queries import sqltext as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_DOMAIN = "replace(regexp_extract(url, '^https?://([^/]+)', 1), 'www.', '')"


_HOST = "regexp_extract(address, '^https?://([^/]+)/', 1)"


@query("i1_build_evidence", with_views(f"""+ s AS (SELECT r.* REPLACE (coalesce(address, CASE WHEN nth % 4 = 0 THEN url END) AS address) FROM reporting r JOIN reported USING (event_id)),
g AS (SELECT * FROM s WHERE address IS NOT NULL
  UNION ALL SELECT event_id, 0, url, 'Unknown source', NULL, 3, false FROM reported r WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.event_id = r.event_id AND address IS NOT NULL)),
d AS (SELECT g.*, title, coalesce(own_date, published_at) AS published_at FROM g JOIN reported USING (event_id)),
i AS (SELECT *, substring(sha256(concat_ws('|', 'evidence', event_id, address, authority, published_at)), 1, 24) AS id FROM d)
SELECT id, event_id, authority, title, address, {_HOST} AS domain, published_at, arg_max(tier, nth * 10 + tier) AS tier, arg_max(official OR tier = 0, nth * 10 + tier) AS official FROM i GROUP BY id, event_id, authority, title, address, published_at""", "reported", "reporting"))
def build_evidence(spark: SparkSession, d: str) -> DataFrame:
    return C.build_evidence(X.reported(spark, d)).drop("provider", "source_id")


_CLAIMED = f"""+ p AS (SELECT event_id, 'fact' AS kind, published_at, lifecycle, coalesce(facts, [coalesce(summary, title)]) AS texts FROM reported UNION ALL SELECT event_id, 'interpretation', published_at, lifecycle, interpretations FROM reported WHERE interpretations IS NOT NULL),
u AS (SELECT event_id, kind, published_at, lifecycle, unnest(texts) AS text, generate_subscripts(texts, 1) AS sequence FROM p),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(translate(text, {T.quoted(T.ACCENTED)}, {T.quoted(T.PLAIN)})), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS normalized_text FROM u)
SELECT substring(sha256(concat_ws('|', 'claim', event_id, kind, nullif(sequence - 1, 0), nullif(normalized_text, ''))), 1, 24) AS claim_id, event_id, kind, CAST(sequence AS INT) AS sequence, text, normalized_text,
  CASE WHEN event_id % 9 = 1 THEN 'e1' ELSE 'e' || event_id % 9 || ',e1' END AS entity_ids, published_at AS observed_at, lifecycle, 1 AS version FROM n"""


@query("i2_build_claims", with_views(_CLAIMED, "reported"))
def build_claims(spark: SparkSession, d: str) -> DataFrame:
    return C.build_claims(X.reported(spark, d)).withColumn("entity_ids", F.array_join("entity_ids", ","))


@query("f7_claim_sequence", with_views("SELECT claim_id, event_id, kind, CAST(row_number() OVER (PARTITION BY event_id, kind ORDER BY observed_at, claim_id) AS INT) AS sequence FROM claims", "claims"))
def claim_sequence(spark: SparkSession, d: str) -> DataFrame:
    return C.claim_sequence(X.claims(spark, d))


_SUPPORT = f"""+ g AS (SELECT claim_id, count(*) AS n, count(DISTINCT {_DOMAIN}) AS d FROM evidence WHERE url LIKE 'http%' GROUP BY claim_id),
s AS (SELECT claim_id, CASE WHEN kind = 'interpretation' THEN 'interpretation' WHEN g.n > 0 THEN 'provisional' ELSE 'unsupported' END AS support, coalesce(g.n, 0) AS n_evidence, coalesce(g.d, 0) AS n_domains FROM claims LEFT JOIN g USING (claim_id))"""


@query("i3_assess_support", with_views(_SUPPORT + " SELECT * FROM s", "claims", "evidence"))
def assess_support(spark: SparkSession, d: str) -> DataFrame:
    return C.assess_support(X.claims(spark, d), X.evidence(spark, d))


@query("i4_support_violations", with_views("""+ v AS (SELECT 'duplicate_claim' AS rule FROM claims GROUP BY claim_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_evidence' FROM evidence GROUP BY evidence_id HAVING count(*) > 1
UNION ALL SELECT 'unsafe_address' FROM evidence WHERE url NOT LIKE 'http%'
UNION ALL SELECT 'orphan_evidence' FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.claim_id = e.claim_id)
UNION ALL SELECT 'fact_without_evidence' FROM claims c WHERE kind = 'fact' AND NOT EXISTS (SELECT 1 FROM evidence e WHERE c.claim_id = e.claim_id))
SELECT rule, count(*) AS n FROM v GROUP BY rule""", "claims", "evidence"))
def support_violations(spark: SparkSession, d: str) -> DataFrame:
    return C.support_violations(X.claims(spark, d), X.evidence(spark, d))


@query("i10_unsupported_material", with_views(_SUPPORT + " SELECT claim_id, c.event_id, CAST(c.event_id % 101 AS INT) AS materiality FROM s JOIN claims c USING (claim_id) WHERE support = 'unsupported' AND c.event_id % 101 >= 65", "claims", "evidence"))
def unsupported_material(spark: SparkSession, d: str) -> DataFrame:
    c = X.claims(spark, d)
    m = c.select("event_id", (F.col("event_id") % 101).cast("int").alias("materiality")).distinct()
    return C.unsupported_material(c, C.assess_support(c, X.evidence(spark, d)), m)


@query("d8_orphan_evidence", with_views("SELECT claim_id, evidence_id FROM evidence WHERE tier = 1", "evidence"))
def orphan_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = X.evidence(spark, d)
    # evidence of tier 1 is taken away from the table that the links point to
    return C.orphan_evidence(e.select("claim_id", "evidence_id"), e.filter("tier <> 1"))


@query("c9_filter_claims", with_views("SELECT claim_id, event_id FROM claims WHERE kind = 'fact' AND lifecycle = 'closed' AND (event_id % 9 = 4 OR claim_id % 5 = 4) AND contains('e' || event_id % 9 || ' e' || claim_id % 5 || ' ' || event_id, '7')", "claims"))
def filter_claims(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*[F.concat(F.lit("e"), (F.col(c) % n).cast("string")) for c, n in (("event_id", 9), ("claim_id", 5))])
    return C.filter_claims(X.claims(spark, d).withColumn("entity_ids", ids), kind="fact", lifecycle="closed", text=" 7 ", entity_id="e4").select("claim_id", "event_id")


@query("d9_project_graph", with_views("SELECT evidence_id, claim_id, tier FROM evidence WHERE claim_id IN (SELECT claim_id FROM claims WHERE kind = 'interpretation')", "claims", "evidence"))
def project_graph(spark: SparkSession, d: str) -> DataFrame:
    picked = C.filter_claims(X.claims(spark, d), kind="interpretation")
    return C.project_graph(picked, X.evidence(spark, d))["evidence"].select("evidence_id", "claim_id", "tier")


@query("e17_graph_summary", with_views("""SELECT count(*) AS claims, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'interpretation') AS interpretations, count(DISTINCT event_id) AS events,
count(*) FILTER (lifecycle = 'closed') AS closed, (SELECT count(*) FROM evidence) AS evidence, (SELECT count(DISTINCT evidence_id) FROM evidence) AS distinct_evidence FROM claims""", "claims", "evidence"))
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.graph_summary(X.claims(spark, d), X.evidence(spark, d))


@query("e17_facts_per_event", with_views("SELECT event_id, count(*) FILTER (kind = 'fact') AS facts, count(*) AS claims FROM claims GROUP BY event_id", "claims"))
def facts_per_event(spark: SparkSession, d: str) -> DataFrame:
    return C.facts_per_event(X.claims(spark, d))


_FACTS_WORDS = f"list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(translate(headline, {T.quoted(T.ACCENTED)}, {T.quoted(T.PLAIN)})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4)))"


@query("i5_contradictions", with_views(f"""+ f AS (SELECT event_id, source AS scope, {_FACTS_WORDS} AS words, regexp_matches(lower(headline), '(^| )(of|un|que)( |$)') AS cue FROM served),
g AS (SELECT scope, words, cue, min(event_id) AS id FROM f WHERE len(words) > 0 GROUP BY ALL),
p AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, len(list_intersect(x.words, y.words))::DOUBLE / least(len(x.words), len(y.words)) AS overlap FROM g x JOIN g y ON x.scope = y.scope AND x.cue AND NOT y.cue)
SELECT substring(sha256('contradiction|' || a || '|' || b), 1, 24) AS id, a, b, overlap FROM p WHERE overlap >= 0.2""", "served"))
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    facts = X.served(spark, d).select(F.col("event_id").alias("claim_id"), F.col("source").alias("scope"), F.col("headline").alias("text"))
    return C.contradictions(facts, overlap=0.2, negation="(^| )(of|un|que)( |$)")


def corrections(spark: SparkSession, d: str) -> DataFrame:
    """Two corrections of every order."""
    n = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), n.alias("n"), F.col("o_orderdate").alias("day"))
    return rows.select("claim_id", F.concat_ws("-", F.lit("r"), F.col("claim_id").cast("string"), F.col("n").cast("string")).alias("request_id"), F.expr("date_add(CAST(day AS DATE), n)").alias("created_at"), F.concat(F.lit("text "), F.col("n").cast("string")).alias("text"), F.lit("first").alias("original"), F.lit("editor").alias("actor"))


_CORRECTIONS = """+ corr AS (SELECT o_orderkey AS claim_id, 'r-' || o_orderkey || '-' || n AS request_id, CAST(o_orderdate AS DATE) + CAST(n AS INT) AS created_at, 'text ' || n AS text, 'first' AS original
  FROM orders, (VALUES (1), (2)) v(n))"""


@query("f6_correction_versions", with_views(_CORRECTIONS + """ SELECT claim_id, request_id, CAST(row_number() OVER w + 1 AS INT) AS version, coalesce(lag(text) OVER w, original) AS previous_text, lag(request_id) OVER w AS supersedes, text
FROM corr WINDOW w AS (PARTITION BY claim_id ORDER BY created_at, request_id)""", "claims"))
def correction_versions(spark: SparkSession, d: str) -> DataFrame:
    return C.correction_versions(corrections(spark, d))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """The corrections as requests with their evidence, the second of every seventh claim with some that does not exist; of every fourth a later one with its id and another text."""
    proof = X.evidence(spark, d).groupBy("claim_id").agg(F.collect_set("evidence_id").alias("ids"))
    rows = corrections(spark, d).join(proof, "claim_id", "left")
    second = F.endswith("request_id", F.lit("-2"))
    lost = F.when(second & (F.col("claim_id") % 7 == 0), F.array(F.concat(F.lit("none-"), F.col("claim_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("evidence_ids", F.concat(F.coalesce("ids", F.array().cast("array<string>")), lost)).drop("ids")
    again = rows.filter(second & (F.col("claim_id") % 4 == 0)).withColumns({"text": F.lit("other"), "created_at": F.date_add("created_at", 9), "evidence_ids": F.array().cast("array<string>")})
    return rows.unionByName(again)


@query("i7_apply_corrections", with_views(_CORRECTIONS + """, q AS (SELECT request_id, claim_id, request_id LIKE '%-1' AS first, false AS again FROM corr UNION ALL SELECT request_id, claim_id, false, true FROM corr WHERE request_id LIKE '%-2' AND claim_id % 4 = 0)
SELECT request_id, claim_id, CASE WHEN first THEN 'replayed' WHEN claim_id % 5 = 0 THEN 'rejected' WHEN claim_id % 7 = 0 AND NOT again THEN 'rejected' WHEN again AND claim_id % 7 <> 0 THEN 'conflict' ELSE 'applied' END AS result FROM q""", "claims"))
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    stored = corrections(spark, d).filter("request_id LIKE '%-1'")
    return C.apply_corrections(X.claims(spark, d), stored, requests(spark, d), X.evidence(spark, d))[1]


@query("i7_mark_corrected", with_views("SELECT claim_id, kind, CASE WHEN claim_id % 3 = 0 THEN 'corrected' ELSE lifecycle END AS lifecycle, CASE WHEN claim_id % 3 = 0 THEN 'r-' || claim_id || '-2' ELSE '' END AS correction_id FROM claims", "claims"))
def mark_corrected(spark: SparkSession, d: str) -> DataFrame:
    return C.mark_corrected(X.claims(spark, d), corrections(spark, d).filter("claim_id % 3 = 0")).select("claim_id", "kind", "lifecycle", F.coalesce("correction_id", F.lit("")).alias("correction_id"))


@query("i7_correction_audit", with_views(_CORRECTIONS + """ SELECT request_id, claim_id AS object_id, 'editor correct claim' AS what, CASE WHEN request_id LIKE '%-1' THEN 'first ' || lifecycle ELSE 'text 1 corrected' END AS before, text || CASE WHEN request_id LIKE '%-1' THEN ' 2' ELSE ' 3' END AS after
FROM corr JOIN claims USING (claim_id)""", "claims"))
def correction_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = C.correction_audit(X.claims(spark, d), corrections(spark, d))
    old, new = F.concat_ws(" ", "previous_value.text", "previous_value.lifecycle"), F.concat_ws(" ", "new_value.text", F.col("new_value.version").cast("string"))
    return rows.select("request_id", "object_id", F.concat_ws(" ", "actor", "action", "object_type").alias("what"), old.alias("before"), new.alias("after"))


@query("d14_claim_history", with_views(_CORRECTIONS + """, l AS (SELECT claim_id, arg_max(text, created_at) AS t, string_agg(text, ',' ORDER BY created_at) AS texts, string_agg(request_id, ',' ORDER BY created_at) AS ids FROM corr WHERE claim_id % 3 > 0 GROUP BY claim_id),
e AS (SELECT claim_id, string_agg(evidence_id, ',' ORDER BY tier = 1, tier DESC, evidence_id) AS ids FROM (SELECT DISTINCT claim_id, evidence_id, tier FROM evidence) GROUP BY claim_id)
SELECT claim_id, coalesce(l.t, lifecycle) AS current_text, coalesce(e.ids, '') AS evidence, coalesce(l.texts, '') AS corrections, coalesce(l.ids, '') AS audit FROM claims LEFT JOIN l USING (claim_id) LEFT JOIN e USING (claim_id)""", "claims", "evidence"))
def claim_history(spark: SparkSession, d: str) -> DataFrame:
    c, e, changed = X.claims(spark, d).withColumn("text", F.col("lifecycle")), X.evidence(spark, d), corrections(spark, d).filter("claim_id % 3 > 0")
    dated = e.withColumn("published_at", F.when(F.col("tier") != 1, F.expr("date_sub(DATE '2024-01-01', tier)")))
    rows = C.claim_history(c, e, dated, C.correction_versions(changed, ["created_at"]), C.correction_audit(c, changed))
    return rows.select("claim_id", "current_text", *[F.array_join(f"{k}.{f}", ",").alias(k) for k, f in (("evidence", "evidence_id"), ("corrections", "text"), ("audit", "request_id"))])


@query("d13_unknown_correction_evidence", with_views(_CORRECTIONS + " SELECT request_id, claim_id, 'none-' || claim_id AS evidence_id FROM corr WHERE claim_id % 7 = 0 AND request_id LIKE '%-2'", "claims"))
def unknown_correction_evidence(spark: SparkSession, d: str) -> DataFrame:
    return C.unknown_correction_evidence(requests(spark, d), X.evidence(spark, d))


@query("i6_merge_graph", with_views("""SELECT claim_id, event_id, CASE WHEN claim_id % 3 = 0 THEN 'run1' ELSE 'run2' END AS first_seen,
CASE WHEN claim_id % 2 = 0 THEN 'run2' ELSE 'run1' END AS last_seen, CASE WHEN claim_id % 3 = 0 AND lifecycle = 'closed' THEN 'closed' WHEN claim_id % 2 = 0 THEN 'observed' ELSE lifecycle END AS lifecycle
FROM claims WHERE claim_id % 3 = 0 OR claim_id % 2 = 0""", "claims"))
def merge_graph(spark: SparkSession, d: str) -> DataFrame:
    c = X.claims(spark, d).select("claim_id", "event_id", "lifecycle")
    old = c.filter("claim_id % 3 = 0").select("claim_id", "event_id", F.lit("run1").alias("first_seen"), F.lit("run1").alias("last_seen"), "lifecycle")
    new = c.filter("claim_id % 2 = 0").select("claim_id", "event_id", F.lit("run2").alias("first_seen"), F.lit("run2").alias("last_seen"), F.lit("observed").alias("lifecycle"))
    return merge_table(old, new, ["claim_id"], insert_only=["first_seen"], sticky={"lifecycle": "closed"})


_RUN = md5(b"c1|2024-01-31|").hexdigest()


def graph_sides(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A stored graph of every third claim, and a new one of every second, with what belongs to them."""
    sides = []
    for divisor, tone in ((3, "old"), (2, "new")):
        c = X.claims(spark, d).filter(F.col("claim_id") % divisor == 0)
        e = X.evidence(spark, d).filter(F.col("claim_id") % divisor == 0)
        status = F.when((F.col("claim_id") % 4 == 0) & (F.lit(tone) == "old"), "resolved").otherwise("potential")
        sides.append({
            "events": c.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")),
            "evidence": e.select("evidence_id", F.concat_ws("-", F.lit(tone), F.col("tier").cast("string")).alias("tier")),
            "claims": c.select("claim_id", F.concat_ws("-", F.lit(tone), "lifecycle").alias("lifecycle")),
            "links": e.select("claim_id", "evidence_id"),
            "corrections": corrections(spark, d).filter(F.col("claim_id") % divisor == 0).select("request_id", F.lit(tone).alias("text"), F.lit("").alias("evidence_ids"), F.concat(F.lit("reason "), F.lit(tone)).alias("reason")),
            "contradictions": c.filter("kind = 'interpretation'").select(F.col("claim_id").alias("id"), status.alias("status")),
            "quality": c.agg(F.lit(True).alias("publishable"), F.count_if(F.col("kind").isNull()).alias("unsupported_material")),
        })
    store, graph = sides
    for name in ("events", "evidence", "claims", "contradictions"):
        store[name] = store[name].withColumns({"first_run": F.lit("r0"), "last_run": F.lit("r0")})
    for name in ("links", "corrections"):
        store[name] = store[name].withColumn("first_run", F.lit("r0"))
    counts = ("events", "evidence", "claims", "links", "corrections", "contradictions")
    store["audit"] = store["quality"].agg(F.lit("r0").alias("run_id"), F.lit("ingestor").alias("actor"), F.lit("ingest").alias("action"), F.lit(None).cast("string").alias("request_id"), *[F.lit(0).cast("long").alias(c) for c in counts])
    return store, graph


def _merged(table: str, id: str, base: str, state: str, key: str = "claim_id", last: bool = True) -> str:
    """SQL of one merged table: rows of both sides by the key, and the state from o (old) and n (new), true where that side has the row."""
    first = f"CASE WHEN o THEN 'r0' ELSE '{_RUN}' END"
    return f"SELECT '{table}' AS part, {id} AS id, {first} AS first_run, {f"CASE WHEN n THEN '{_RUN}' ELSE 'r0' END" if last else first} AS last_run, {state} AS state FROM (SELECT *, {key} % 3 = 0 AS o, {key} % 2 = 0 AS n FROM {base}) WHERE o OR n"


_BOTH = "CASE WHEN n THEN 'new' ELSE 'old' END"
_GRAPH_SQL = _CORRECTIONS + ", merged AS (" + " UNION ALL ".join([
    f"SELECT 'events', event_id::VARCHAR, CASE WHEN a > 0 THEN 'r0' ELSE '{_RUN}' END, CASE WHEN b > 0 THEN '{_RUN}' ELSE 'r0' END, CASE WHEN b > 0 THEN b ELSE a END::VARCHAR FROM (SELECT event_id, count(*) FILTER (claim_id % 3 = 0) AS a, count(*) FILTER (claim_id % 2 = 0) AS b FROM claims GROUP BY 1) WHERE a + b > 0",
    _merged("evidence", "evidence_id", "evidence", _BOTH + " || '-' || tier"),
    _merged("claims", "claim_id::VARCHAR", "claims", _BOTH + " || '-' || lifecycle"),
    _merged("links", "claim_id || ' ' || evidence_id", "evidence", "''", last=False),
    _merged("corrections", "request_id", "corr", "CASE WHEN o THEN 'old' ELSE 'new' END || ' reason ' || " + _BOTH, last=False),
    _merged("contradictions", "claim_id::VARCHAR", "(SELECT * FROM claims WHERE kind = 'interpretation')", "CASE WHEN o AND claim_id % 4 = 0 THEN 'resolved' ELSE 'potential' END"),
    "SELECT 'audit', 'r0', 'r0', 'r0', '0 0 0 0 0 0'",
    f"""SELECT 'audit', '{_RUN}', '{_RUN}', '{_RUN}', concat_ws(' ', (SELECT count(DISTINCT event_id) FROM claims WHERE claim_id % 2 = 0), (SELECT count(*) FROM evidence WHERE claim_id % 2 = 0), (SELECT count(*) FROM claims WHERE claim_id % 2 = 0),
(SELECT count(*) FROM evidence WHERE claim_id % 2 = 0), (SELECT count(*) FROM corr WHERE claim_id % 2 = 0), (SELECT count(*) FROM claims WHERE claim_id % 2 = 0 AND kind = 'interpretation'))""",
]) + ")"
_GRAPH_SQL = _GRAPH_SQL.replace("merged AS (", "merged(part, id, first_run, last_run, state) AS (")


@query("a11_upsert_claim_graph", with_views(_GRAPH_SQL + " SELECT * FROM merged", "claims", "evidence"))
def upsert_graph(spark: SparkSession, d: str) -> DataFrame:
    new = upsert_claim_graph(*graph_sides(spark, d), "c1", "2024-01-31")
    shapes = {
        "events": ("event_id", "n"), "evidence": ("evidence_id", "tier"), "claims": ("claim_id", "lifecycle"), "links": ("claim_id", None), "corrections": ("request_id", None), "contradictions": ("id", "status"), "audit": ("run_id", None),
    }
    states = {"links": F.lit(""), "corrections": F.concat_ws(" ", "text", "reason"), "audit": F.concat_ws(" ", *[F.col(c).cast("string") for c in list(shapes)[:-1]])}
    ids = {"links": F.concat_ws(" ", F.col("claim_id").cast("string"), "evidence_id")}
    parts = []
    for name, (key, state) in shapes.items():
        first = F.col("run_id") if name == "audit" else F.col("first_run")
        last = F.col("last_run") if "last_run" in new[name].columns else first
        parts.append(new[name].select(F.lit(name).alias("part"), ids.get(name, F.col(key).cast("string")).alias("id"), first.alias("first_run"), last.alias("last_run"), (states[name] if state is None else F.col(state).cast("string")).alias("state")))
    return reduce(DataFrame.unionAll, parts)


@query("a11_ingest_gate", with_views("SELECT 'not_publishable' AS rule, 0 AS violations UNION ALL SELECT 'unsupported_material', 0 UNION ALL SELECT 'unknown_evidence', count(*) FROM evidence WHERE claim_id % 2 = 0 AND claim_id % 3 <> 0 AND tier = 1", "evidence"))
def gate_of_ingest(spark: SparkSession, d: str) -> DataFrame:
    store, graph = graph_sides(spark, d)
    # the new evidence of tier 1 is left out, so that its links lead nowhere unless the store has it
    return ingest_gate(store, graph | {"evidence": graph["evidence"].filter("tier <> 'new-1'")})


_SENT = f"""+ v AS (SELECT *, headline <> '' AND summary <> '' AND NOT bare AND event_id % 31 <> 0 AS good FROM told),
n AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY event_id % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS nth FROM v),
rows AS (SELECT event_id, headline, bucket, status, CASE WHEN status = 'confirmed' THEN 'confirmed' ELSE 'developing' END AS lifecycle, coalesce(category, 'Corporate') AS category, summary, why, materiality::DOUBLE AS materiality, CASE WHEN event_id % 8 <> 0 THEN certainty::DOUBLE END AS certainty,
  momentum::DOUBLE AS momentum, tone::DOUBLE AS sentiment, tone::DOUBLE AS media_tone, NULL::DOUBLE AS public_score, sample_size, 0 AS channel_count, 'unavailable' AS confidence, NULL::DOUBLE AS reputation_impact, narrative_alignment::DOUBLE AS narrative_alignment,
  source_count, coalesce(first_date, published_at) AS first_reported_at, published_at, updated_at, true AS is_published FROM n WHERE good AND nth <= 250)"""


@query("a9_upsert_events", with_views(_SENT + """ SELECT * REPLACE (CASE WHEN event_id % 5 <> 0 THEN headline ELSE 'old' END AS headline) FROM rows WHERE event_id % 2 = 0 OR event_id % 5 <> 0""", "served", "told"))
def upsert_events(spark: SparkSession, d: str) -> DataFrame:
    """Three calls of events go through the gate and become rows; of these four fifths are merged into a store that holds the even ones."""
    sent = X.told(spark, d).withColumns({"call": F.col("event_id") % 3, "certainty": F.when(F.col("event_id") % 8 == 0, "none").otherwise(F.col("certainty").cast("string")), "media_tone": F.col("tone")})
    accepted = validate_events(sent, "call", "event_id", 250).filter("verdict = 'accepted'")
    rows = materialize(stored_rows(accepted, X.now()))
    return merge_table(rows.filter("event_id % 2 = 0").withColumn("headline", F.lit("old")), rows.filter("event_id % 5 <> 0"), ["event_id"])


_JSON = """'{"claim_id":' || claim_id || ',"event_id":' || event_id || ',"kind":"' || kind || '","lifecycle":"' || lifecycle || '"}'"""


_PRINTED = ["claim_id", "event_id", "kind", "lifecycle"]


def _print_sql(view: str) -> str:
    """SQL of the fingerprint of a view: n, lanes, content."""
    lanes = ", ".join(f"(sum(CAST('0x' || substr(sha256(j || '|{i // 4}'), {1 + 16 * (i % 4)}, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616)::VARCHAR" for i in range(C.LANES))
    return f"(SELECT n, lanes, sha256(n || '|' || lanes) AS content FROM (SELECT count(*) AS n, concat_ws('|', {lanes}) AS lanes FROM (SELECT {_JSON} AS j FROM {view})))"


def _told(fingerprint: DataFrame) -> DataFrame:
    return fingerprint.select("rows", F.array_join(F.transform("lanes", lambda x: x.cast("string")), "|").alias("lanes"), C.fingerprint_text().alias("content"))


@query("i9_content_fingerprint", with_views(f"""SELECT n AS "rows", lanes, content FROM {_print_sql("claims")}""", "claims"))
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _told(C.content_fingerprint(X.claims(spark, d), _PRINTED))


_MERGED = "SELECT claim_id, event_id, kind, CASE WHEN claim_id % 3 = 0 THEN 'closed' ELSE lifecycle END AS lifecycle FROM claims WHERE claim_id % 2 = 0 OR claim_id % 3 = 0"


@query("i9_changed_fingerprint", with_views(f"""+ merged AS ({_MERGED}) SELECT n AS "rows", lanes, content FROM {_print_sql("merged")}""", "claims"))
def changed_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint after a merge, from the one before it and the rows that changed."""
    c = X.claims(spark, d)
    old, new = c.filter("claim_id % 2 = 0"), c.filter("claim_id % 3 = 0").withColumn("lifecycle", F.lit("closed"))
    gone = old.join(new.select("claim_id"), "claim_id", "left_semi")
    return _told(C.changed_fingerprint(*[C.content_fingerprint(rows, _PRINTED) for rows in (old, gone, new)]))


def generation(claims: DataFrame, attempt: int, prefix: str = "") -> DataFrame:
    """The head of a generation whose content is the fingerprint of its claims."""
    made = {"generated_at": "2024-01-30T23:30:00Z", "window_start": "2024-01-01T00:00:00Z", "window_end": "2024-01-30T23:00:00Z", "source_commit": "a" * 40, "source_repository": None, "source_run": "7", "source_attempt": str(attempt)}
    n = C.content_fingerprint(claims, _PRINTED).select(C.fingerprint_text().alias(f"{prefix}content"))
    return n.withColumns({prefix + k: F.lit(v).cast("string") for k, v in made.items()})


_GENERATION = """'generated_at=2024-01-30T23:30:00Z' || chr(10) || 'window_start=2024-01-01T00:00:00Z' || chr(10) || 'window_end=2024-01-30T23:00:00Z' || chr(10) || 'source_commit=' || repeat('a', 40) || chr(10) || 'source_repository=' || chr(0)
|| chr(10) || 'source_run=7' || chr(10) || 'source_attempt=' || {} || chr(10) || 'content=' || {}.content"""


@query("i9_compare_generations", with_views(f"""+ kept AS (SELECT * FROM claims WHERE lifecycle <> 'closed'), a AS {_print_sql("claims")}, b AS {_print_sql("kept")}
SELECT unnest(['source_attempt', 'content', 'generation_id']) AS field, unnest(['1', a.content, sha256({_GENERATION.format(1, "a")})]) AS published, unnest(['2', b.content, sha256({_GENERATION.format(2, "b")})]) AS expected FROM a, b""", "claims"))
def compare_generations(spark: SparkSession, d: str) -> DataFrame:
    """All claims against those that are not closed, made by another attempt."""
    c = X.claims(spark, d)
    return C.compare_generations(generation(c, 1), generation(c.filter("lifecycle <> 'closed'"), 2))


@query("i8_graph_gate", with_views("""SELECT 'orphan_evidence' AS rule, count(*) AS violations FROM evidence WHERE tier = 1 UNION ALL SELECT 'evidence_count', CASE WHEN count(*) FILTER (tier = 1) > 0 THEN 1 ELSE 0 END FROM evidence
UNION ALL SELECT unnest(['publishable', 'unsupported_material', 'fresh', 'event_count', 'claim_count', 'input_window', 'input_before_graph', 'input_events']), 0 UNION ALL SELECT unnest(['input_identity', 'input_fresh']), 1""", "evidence"))
def graph_gate(spark: SparkSession, d: str) -> DataFrame:
    c, e = X.claims(spark, d), X.evidence(spark, d)
    declared = c.agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("event_id").alias("events"), F.count_if(F.col("kind").isNull()).alias("unsupported_material")).crossJoin(e.agg(F.count(F.lit(1)).alias("evidence")))  # rows of one
    head = declared.crossJoin(generation(c, 1, "input_")).withColumns({
        "publishable": F.lit(True), "generated_at": F.lit("2024-01-31T00:00:00Z"), "source_commit": F.lit("a" * 40), "input_events": F.col("events"), "named_generated_at": F.col("input_generated_at"), "named_commit": F.lit("a" * 40), "named_run": F.lit("7"), "named_attempt": F.lit("2"),
        "input_generation_id": C.generation_id("input_"),
    })
    # the gate looks three hours after the input; evidence of tier 1 is lost; the attempt that the graph names is another one
    return C.graph_gate(c, e, e.filter("tier <> 1"), head, F.lit("2024-01-31T02:10:00Z").cast("timestamp"))


_SHOWN = f"""+ l AS (SELECT l_orderkey AS event_id, l_linenumber AS nth, CASE WHEN l_orderkey % 7 <> 0 AND l_linenumber % 4 IN (1, 2) THEN 's' || l_orderkey % 50 || '.example.com' ELSE '' END AS domain, CASE WHEN l_linenumber <> 6 THEN 'N' || l_suppkey % 3 END AS name,
  CASE WHEN l_linenumber % 2 = 1 THEN 'A' || l_suppkey % 3 END AS authority, CASE WHEN l_linenumber % 2 = 1 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS own_date, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_suppkey % 4 AS INT) END AS tier,
  CASE WHEN l_orderkey % 7 <> 0 AND l_linenumber % 4 = 0 THEN 'link' END AS link FROM lineitem),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(domain, ''), lower(name), 'unknown-source') ORDER BY event_id, nth, link NULLS FIRST, authority NULLS FIRST, name NULLS FIRST, own_date NULLS FIRST, tier NULLS FIRST) AS k FROM l) WHERE k = 1),
e AS (SELECT f.domain, arg_min(r.name, registry_ord) AS rname, arg_min(r.tier, registry_ord) AS rtier, arg_min(r.class, registry_ord) AS class FROM f JOIN registry r ON f.domain = r.domain OR f.domain LIKE '%.' || r.domain GROUP BY f.domain),
shown AS (SELECT coalesce(f.name, rname, nullif(f.domain, ''), 'Unnamed source') AS name, f.domain, coalesce(f.tier, rtier, 3) AS tier, coalesce(nullif(class, ''), CASE f.tier WHEN 0 THEN 'official' WHEN 1 THEN 'major-media' WHEN 2 THEN 'specialist-media' ELSE 'discovery-index' END) AS class, '' AS provider FROM f LEFT JOIN e ON f.domain = e.domain)"""


@query("d15_evidence_sources", with_views(_SHOWN + " SELECT * FROM shown", "registry"))
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.evidence_sources(X.reported(spark, d), X.registry(spark, d))


_GROUP = """CASE WHEN class IN ('official', 'official-filing') THEN 'Official company / IR' WHEN class IN ('exchange', 'regulator') THEN 'Exchanges & regulators' WHEN class = 'major-media' THEN 'Major journalism'
  WHEN class IN ('specialist-media', 'regional') THEN 'Specialist & regional media' WHEN class = 'discovery-index' THEN 'Open discovery' ELSE 'Other evidence' END"""


@query("e20_coverage_snapshot", with_views(_SHOWN + f""", c AS (SELECT CASE WHEN class <> '' THEN class WHEN tier = 0 THEN 'official' WHEN tier = 1 THEN 'major-media' WHEN tier = 2 THEN 'specialist-media' ELSE 'discovery-index' END AS class FROM registry WHERE active),
b AS (SELECT {_GROUP} AS name, 1 AS c, 0 AS v FROM c UNION ALL SELECT {_GROUP}, 0, 1 FROM shown) SELECT name, CAST(sum(c) AS BIGINT) AS configured, CAST(sum(v) AS BIGINT) AS evidenced FROM b GROUP BY name""", "registry"))
def coverage_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage_snapshot(evidence_sources(spark, d), X.registry(spark, d))
