"""Queries over articles, clusters and events, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine import fixtures as X
from evidence_engine import params as P
from evidence_engine.fixtures import LEXICON, with_views
from evidence_engine.operators import articles as A
from evidence_engine.operators import cluster as C
from evidence_engine.operators import events as E
from evidence_engine.plans.materialize import materialize
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


def _stamp(text: str):
    return F.lit(text).cast("timestamp")


@query(
    "b_article_features",
    with_views(
        rf"""+ n AS (SELECT *, {T.normalized("title")} AS t, {T.normalized("title || ' ' || description")} AS b FROM articles)
SELECT ord, t AS norm_title, array_to_string({T.tokens("title")}, ' ') AS tokens, replace(host, 'www.', '') AS domain, regexp_replace(url, '[?#].*$', '') AS address,
  regexp_replace(url, '\?.*$', '') AS traceable,
  substring(sha256('article|' || url), 1, 24) AS stable_id, {T.tone("b")} AS tone, {T.category("b")} AS category FROM n""",
        "articles",
    ),
)
def article_features(spark: SparkSession, d: str) -> DataFrame:
    # the hash of the title has its own test: DuckDB lacks the exclusive or of a fold
    return A.article_features(X.articles(spark, d), LEXICON).drop("title_hash")


@query(
    "f1_first_wins",
    with_views(
        r"""SELECT job_idx, item_idx, title, url, published_at, item_key FROM (
  SELECT *, regexp_replace(url, '[?#].*$', '') AS item_key, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY job_idx, item_idx) AS n
  FROM raw_items WHERE title <> '' AND url <> '') WHERE n = 1""",
        "articles",
        "raw_items",
    ),
)
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return A.first_wins(X.raw_items(spark, d), ["job_idx", "item_idx"])


@query("c1_fresh_articles", with_views(f"SELECT ord, published_at FROM articles WHERE published_at BETWEEN {T.STAMP} - INTERVAL 96 HOURS AND {T.STAMP} + INTERVAL 12 HOURS", "articles"))
def fresh(spark: SparkSession, d: str) -> DataFrame:
    return A.fresh_articles(X.articles(spark, d), X.now()).select("ord", "published_at")


@query("a8_filter_records", with_views("SELECT ord, source_name, published_at FROM articles WHERE published_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND source_name IN ('src1', 'src2', 'src3')", "articles"))
def filter_records(spark: SparkSession, d: str) -> DataFrame:
    rows = A.filter_records(X.articles(spark, d), _stamp("2024-01-10 00:00:00"), _stamp("2024-01-20 00:00:00"), ["src1", "src2", "src3"])
    return rows.select("ord", "source_name", "published_at")


@query("d1_match_entities", with_views("+ " + T.matches("m", "articles", "title || ' ' || description") + " SELECT * FROM m", "articles"))
def match_entities(spark: SparkSession, d: str) -> DataFrame:
    docs = X.articles(spark, d).select("ord", F.concat_ws(" ", "title", "description").alias("text"))
    return A.match_entities(docs, X.entities(spark), LEXICON)


@query("d2_source_tier", with_views("SELECT ord, host, coalesce(tier, 3) AS tier FROM articles LEFT JOIN sources ON replace(host, 'www.', '') = domain", "articles", "sources"))
def source_tier(spark: SparkSession, d: str) -> DataFrame:
    return A.source_tier(X.articles(spark, d), X.sources(spark, d), LEXICON).select("ord", "host", "tier")


_RELEVANCE = f"""+ {T.matches("mt", "articles", "title")}, {T.matches("mx", "articles", "title || ' ' || description")},
it AS (SELECT ord, count(*) AS n FROM mt WHERE type <> 'stakeholder' GROUP BY ord),
ix AS (SELECT ord, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM (SELECT ord, entity_id FROM mx WHERE type <> 'stakeholder' UNION ALL SELECT ord, 'e_group' FROM articles WHERE ord % 7 = 0) GROUP BY ord),
r AS (SELECT a.ord, channel = 'public-conversation' AS public, coalesce(it.n, 0) > 0 AS named, coalesce(ix.ids, '') AS ids, official OR s.tier = 0 AS official,
  {T.normalized("title")} AS t, {T.normalized("title || ' ' || description")} AS b
  FROM articles a LEFT JOIN it USING (ord) LEFT JOIN ix USING (ord) LEFT JOIN sources s ON replace(host, 'www.', '') = s.domain),
q AS (SELECT ord, ids, CASE WHEN ids = '' THEN 'no_entity' WHEN public AND {T.any_of("t", LEXICON.public_question)} THEN 'public_question'
  WHEN public AND named THEN 'public_sentiment_only' WHEN public THEN 'weak_public_context'
  WHEN {T.any_of("t", LEXICON.routine_market)} AND NOT official THEN 'routine_market_advice'
  WHEN {T.any_of("t", LEXICON.price_move)} AND NOT {T.any_of("b", LEXICON.corporate_event)} AND NOT official THEN 'price_movement_without_event'
  WHEN NOT named AND NOT official THEN 'entity_only_in_snippet' WHEN official THEN 'official' ELSE 'direct_entity_news' END AS reason FROM r)"""


@query("c3_assess_relevance", with_views(_RELEVANCE + " SELECT ord, reason IN ('official', 'direct_entity_news') AS include_as_news, reason = 'public_sentiment_only' AS include_as_sentiment, reason, ids AS entity_ids FROM q", "articles", "sources"))
def assess_relevance(spark: SparkSession, d: str) -> DataFrame:
    hints = F.when(F.col("ord") % 7 == 0, F.array(F.lit("e_group"), F.lit("e_stake"), F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    return A.assess_relevance(X.articles(spark, d).withColumn("hints", hints), X.entities(spark), X.sources(spark, d), LEXICON)


@query("e10_rejection_reasons", with_views(_RELEVANCE + " SELECT reason, count(*) AS n FROM q WHERE reason NOT IN ('official', 'direct_entity_news') GROUP BY reason", "articles", "sources"))
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    return A.rejection_reasons(assess_relevance(spark, d))


def _grouped(spark: SparkSession, d: str):
    rows = X.articles(spark, d)
    found = A.match_entities(rows.select("ord", F.col("title").alias("text")), X.entities(spark), LEXICON)
    return rows, materialize(C.title_groups(rows, found, LEXICON))


_GROUPS = f"""+ {T.matches("m", "articles", "title")},
ids AS (SELECT ord, list_sort(list(DISTINCT entity_id)) AS ids FROM m GROUP BY ord),
g AS (SELECT a.ord, published_at, {T.tokens("title")} AS tokens, channel = 'public-conversation' AS public, coalesce(ids, []) AS ids FROM articles a LEFT JOIN ids USING (ord)),
k AS (SELECT *, sha256(array_to_string(tokens, ' ') || '|' || public || '|' || array_to_string(ids, ' ')) AS group_id FROM g),
u AS (SELECT group_id, any_value(tokens) AS tokens, any_value(public) AS public, any_value(ids) AS ids FROM k WHERE len(tokens) > 0 GROUP BY group_id),
x AS (SELECT a.group_id AS a, b.group_id AS b, list_intersect(a.tokens, b.tokens) AS common, a.public OR b.public AS public, len(list_intersect(a.ids, b.ids)) > 0 AS entity,
  len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) AS similarity FROM u a JOIN u b ON a.group_id < b.group_id),
y AS (SELECT *, len(common) AS shared, len(list_filter(common, lambda t: regexp_matches(t, '^[0-9]'))) > 0 AS digit FROM x),
pairs AS (SELECT a, b, similarity, CAST(shared AS INT) AS shared FROM y WHERE similarity >= CASE WHEN public THEN 0.72 ELSE 0.64 END
  OR (entity AND CASE WHEN public THEN (shared >= 5 AND similarity >= 0.48) OR (shared >= 4 AND similarity >= 0.42 AND digit)
      ELSE (shared >= 4 AND similarity >= 0.42) OR (shared >= 3 AND similarity >= 0.34 AND digit) END))"""


@query("d4_related_pairs", with_views(_GROUPS + " SELECT * FROM pairs", "articles"))
def related_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.related_pairs(_grouped(spark, d)[1])


_CLUSTERS = (
    _GROUPS
    + """,
o AS (SELECT ord, group_id, len(tokens) > 0 AS some, row_number() OVER (ORDER BY published_at DESC, ord) AS idx FROM k),
near AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT group_id, group_id FROM u),
e AS (SELECT i.idx AS i, j.idx AS j FROM near JOIN o i ON i.group_id = a JOIN o j ON j.group_id = b AND j.idx < i.idx),
reach(i, m) AS (SELECT idx, idx FROM o UNION SELECT r.i, e.j FROM reach r JOIN e ON e.i = r.m),
c AS (SELECT i, min(m) AS m FROM reach GROUP BY i),
members AS (SELECT o.ord, f.ord AS cluster_id FROM c JOIN o ON o.idx = c.i JOIN o f ON f.idx = c.m)"""
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _clustered(spark: SparkSession, d: str):
    rows, groups = _grouped(spark, d)
    pairs = materialize(C.related_pairs(groups))
    return rows, groups, pairs, C.cluster_articles(rows, groups, pairs)


@query("i11_cluster_articles", _recursive(with_views(_CLUSTERS + " SELECT * FROM members", "articles")))
def cluster_articles(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d)[3]


_MOMENTUM = f"""+ h AS (SELECT source_name AS cluster_id, host, date_diff('second', published_at, {T.STAMP}) / 3600.0 AS age FROM articles),
s AS (SELECT cluster_id, count(*) FILTER (age <= 6) AS n6, count(*) FILTER (age <= 12) AS n12, count(*) FILTER (age > 12 AND age <= 24) AS p12, count(*) FILTER (age <= 24) AS n24,
  count(*) FILTER (age > 24 AND age <= 48) AS p24h, count(DISTINCT host) AS n_domains FROM h GROUP BY cluster_id)
SELECT cluster_id, {T.rounded(T.clamped("n6 * 10 + n24 * 3 + n_domains * 6 + least(25.0, 8 * CASE WHEN p24h > 0 THEN n24::DOUBLE / p24h WHEN n24 > 1 THEN 2.0 ELSE 1.0 END)"))} AS momentum,
  CASE WHEN p12 = 0 THEN CASE WHEN n12 > 0 THEN 100 ELSE 0 END ELSE {T.rounded("(n12 - p12)::DOUBLE / p12 * 100")} END AS trend_change, n_domains FROM s"""


@query("e1_momentum_trend", with_views(_MOMENTUM, "articles"))
def momentum(spark: SparkSession, d: str) -> DataFrame:
    return E.momentum(X.articles(spark, d).withColumnRenamed("source_name", "cluster_id"), X.now())


@query(
    "e4_public_sentiment",
    with_views(
        f"""+ w AS (SELECT source_name, language, {T.tone(T.normalized("title || ' ' || description"))} AS t, greatest(1.0, least(5.0, 1.0 + log2(1.0 + greatest(0, engagement)))) AS w FROM articles WHERE channel = 'public-conversation'),
s AS (SELECT source_name, sum(CAST(round(t * w * 1e6) AS BIGINT)) AS tw, sum(CAST(round(w * 1e6) AS BIGINT)) AS w, count(*) AS sample_size, count(DISTINCT language) AS channels FROM w GROUP BY source_name)
SELECT source_name, {T.rounded("tw::DOUBLE / greatest(w, 1000000)")} AS score, sample_size, channels,
  CASE WHEN sample_size >= 25 AND channels >= 2 THEN 'high' WHEN sample_size >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
        "articles",
    ),
)
def public_sentiment(spark: SparkSession, d: str) -> DataFrame:
    from evidence_engine.functions.scores import media_tone
    from evidence_engine.functions.text import normalize_text

    rows = X.articles(spark, d).filter("channel = 'public-conversation'")
    return E.public_sentiment(rows, "source_name", media_tone(normalize_text(F.concat_ws(" ", "title", "description")), LEXICON), F.col("engagement"), F.col("language"))


@query(
    "e5_observation_sentiment",
    with_views(
        f"""+ w AS (SELECT event_key, lower(platform) AS c, tone_score AS t, greatest(1.0, least(8.0, 1.0 + log2(1.0 + greatest(0, engagement_count)))) AS w FROM observations),
s AS (SELECT event_key, sum(CAST(round(t * w * 1e6) AS BIGINT)) AS tw, sum(CAST(round(w * 1e6) AS BIGINT)) AS w, count(*) AS sample_size, count(DISTINCT c) AS channels FROM w GROUP BY event_key)
SELECT event_key, {T.rounded("tw::DOUBLE / greatest(w, 1000000)")} AS score, sample_size, channels,
  CASE WHEN sample_size >= 25 AND channels >= 2 THEN 'high' WHEN sample_size >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM s""",
        "observations",
    ),
)
def observation_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return E.public_sentiment(X.observations(spark, d), "event_key", F.col("tone_score"), F.col("engagement_count"), F.lower("platform"), 8)


def events(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: articles to scored events."""
    rows, _, _, labels = _clustered(spark, d)
    members = E.event_features(rows, LEXICON).join(labels, "ord")
    texts = rows.select("ord", F.concat_ws(" ", "title", "description").alias("text"))
    found = A.match_entities(texts, X.entities(spark), LEXICON)
    tiers = A.source_tier(rows.select("ord", "host"), X.sources(spark, d), LEXICON).select("ord", "tier")
    return E.derive_events(members, found, tiers, X.entities(spark), X.now(), LEXICON, rows.select("ord", "description"))


_SCORES = f"""
, {T.matches("mx", "articles", "title || ' ' || description")},
a AS (SELECT a.*, cluster_id, coalesce(s.tier, 3) AS stier, {T.normalized("title || ' ' || description")} AS b FROM articles a JOIN members USING (ord) LEFT JOIN sources s ON replace(host, 'www.', '') = s.domain),
v AS (SELECT *, {T.tone("b")} AS t, date_diff('second', published_at, {T.STAMP}) / 3600.0 AS age FROM a WHERE channel <> 'public-conversation'),
w AS (SELECT cluster_id, min(CASE WHEN type <> 'stakeholder' THEN mx.tier END) AS etier FROM v JOIN mx USING (ord) GROUP BY cluster_id HAVING count(*) FILTER (type <> 'stakeholder') > 0),
z AS (SELECT cluster_id, min(stier) AS best, bool_or(official OR stier = 0) AS official, count(DISTINCT host) AS nd, avg(t) AS mt, {" , ".join(f"max(CASE WHEN contains(b, {T.quoted(t)}) THEN {v} ELSE 0 END) AS m{i}" for i, (t, v) in enumerate(LEXICON.materiality.items()))},
  max(CASE WHEN contains(b, 'the') THEN 4 ELSE 0 END) AS up, max(CASE WHEN contains(b, 'thble') THEN 6 ELSE 0 END) AS down,
  count(*) FILTER (age <= 6) AS n6, count(*) FILTER (age <= 24) AS n24, count(*) FILTER (age > 24 AND age <= 48) AS p24h, arg_min(title, (stier, -epoch_us(published_at), ord)) AS headline,
  min(published_at) AS published_at, max(published_at) AS updated_at FROM v GROUP BY cluster_id)
SELECT cluster_id, headline, published_at, updated_at, nd AS source_count,
  {T.rounded(T.clamped("8 + " + " + ".join(f"m{i}" for i in range(len(LEXICON.materiality))) + " + [24, 18, 13, 8, 3, 0][least(coalesce(etier, 4), 5) + 1] + least(18.0, log2(greatest(1, nd)) * 7) + CASE best WHEN 0 THEN 18 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END"))} AS materiality,
  {T.rounded(T.clamped("CASE WHEN official OR best = 0 THEN 88 WHEN best = 1 THEN 68 WHEN best = 2 THEN 56 ELSE 42 END + least(8, greatest(0, nd - 1) * 2) + up - down"))} AS certainty,
  {T.rounded(T.clamped("n6 * 10 + n24 * 3 + nd * 6 + least(25.0, 8 * CASE WHEN p24h > 0 THEN n24::DOUBLE / p24h WHEN n24 > 1 THEN 2.0 ELSE 1.0 END)"))} AS momentum, {T.rounded("mt")} AS tone
FROM z JOIN w USING (cluster_id)"""


@query("e8_derive_events", _recursive(with_views(_CLUSTERS + _SCORES, "articles", "sources")))
def derive_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("cluster_id", "headline", "published_at", "updated_at", "source_count", "materiality", "certainty", "momentum", "tone")


_POSITIONS = ", ".join(f"({T.quoted(e[0])}, {T.quoted(e[1])}, {k})" for k, e in enumerate(X.ENTITIES))
_RANK = "(stier, -epoch_us(published_at), ord)"
_EVERY = f"""
, {T.matches("mx", "articles", "title || ' ' || description")}, pos(entity_id, name, position) AS (VALUES {_POSITIONS}),
a AS (SELECT a.*, cluster_id, coalesce(s.tier, 3) AS stier, official OR coalesce(s.tier, 3) = 0 AS off, channel = 'public-conversation' AS public, {T.normalized("title || ' ' || description")} AS b FROM articles a JOIN members USING (ord) LEFT JOIN sources s ON replace(host, 'www.', '') = s.domain),
v AS (SELECT *, {T.tone("b")} AS t, date_diff('second', published_at, {T.STAMP}) / 3600.0 AS age FROM a WHERE NOT public),
w AS (SELECT cluster_id, min(CASE WHEN type <> 'stakeholder' THEN mx.tier END) AS etier, max(CASE WHEN type = 'person' THEN 5 - mx.tier ELSE 0 END) AS senior, count(*) FILTER (type = 'person') AS people, count(*) FILTER (type IN ('group', 'company', 'business')) AS inst,
  string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS entity_ids, arg_min(name, position) FILTER (type <> 'stakeholder') AS lead FROM v JOIN mx USING (ord) JOIN pos USING (entity_id) GROUP BY cluster_id HAVING count(*) FILTER (type <> 'stakeholder') > 0),
p AS (SELECT cluster_id, sum(CAST(round(t * g * 1e6) AS BIGINT)) AS tw, sum(CAST(round(g * 1e6) AS BIGINT)) AS gw, count(*) AS pn FROM (SELECT cluster_id, {T.tone("b")} AS t, greatest(1.0, least(5.0, 1.0 + log2(1.0 + greatest(0, engagement)))) AS g FROM a WHERE public) GROUP BY cluster_id),
l AS (SELECT cluster_id, string_agg(url, ' ' ORDER BY place) AS sources FROM (SELECT cluster_id, url, row_number() OVER (PARTITION BY cluster_id ORDER BY public, stier, published_at DESC, ord) AS place FROM a) WHERE place <= 16 GROUP BY cluster_id),
z AS (SELECT cluster_id, min(stier) AS best, bool_or(off) AS official, count(DISTINCT host) AS nd, avg(t) AS mt, {" , ".join(f"max(CASE WHEN contains(b, {T.quoted(t)}) THEN {v} ELSE 0 END) AS m{i}" for i, (t, v) in enumerate(LEXICON.materiality.items()))},
  {" , ".join(f"bool_or(regexp_matches(b, {T.quoted(p)})) AS c{i}" for i, (_, p) in enumerate(LEXICON.categories))}, bool_or(regexp_matches(b, {T.quoted(LEXICON.immediate)})) AS immediate,
  max(CASE WHEN contains(b, 'the') THEN 4 ELSE 0 END) AS up, max(CASE WHEN contains(b, 'thble') THEN 6 ELSE 0 END) AS down,
  count(*) FILTER (age <= 6) AS n6, count(*) FILTER (age <= 12) AS n12, count(*) FILTER (age > 12 AND age <= 24) AS p12, count(*) FILTER (age <= 24) AS n24, count(*) FILTER (age > 24 AND age <= 48) AS p24h,
  arg_min(title, {_RANK}) AS headline, arg_min(description, {_RANK}) AS body, arg_min(title, {_RANK}) FILTER (off) AS ot, arg_min(title, {_RANK}) FILTER (NOT off) AS other, min(published_at) AS published_at, max(published_at) AS updated_at FROM v GROUP BY cluster_id),
x1 AS (SELECT *, coalesce(other, headline) AS emerging,
  {T.rounded(T.clamped("8 + " + " + ".join(f"m{i}" for i in range(len(LEXICON.materiality))) + " + [24, 18, 13, 8, 3, 0][least(coalesce(etier, 4), 5) + 1] + least(18.0, log2(greatest(1, nd)) * 7) + CASE best WHEN 0 THEN 18 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END"))} AS materiality,
  {T.rounded(T.clamped("CASE WHEN official OR best = 0 THEN 88 WHEN best = 1 THEN 68 WHEN best = 2 THEN 56 ELSE 42 END + least(8, greatest(0, nd - 1) * 2) + up - down"))} AS certainty,
  {T.rounded(T.clamped("n6 * 10 + n24 * 3 + nd * 6 + least(25.0, 8 * CASE WHEN p24h > 0 THEN n24::DOUBLE / p24h WHEN n24 > 1 THEN 2.0 ELSE 1.0 END)"))} AS momentum,
  CASE WHEN p12 = 0 THEN CASE WHEN n12 > 0 THEN 100 ELSE 0 END ELSE {T.rounded("(n12 - p12)::DOUBLE / p12 * 100")} END AS trend_change, {T.rounded("mt")} AS tone FROM z JOIN w USING (cluster_id) LEFT JOIN p USING (cluster_id) LEFT JOIN l USING (cluster_id)),
x2 AS (SELECT *, {T.normalized("emerging")} AS en, {T.tokens("emerging")} AS et, {T.tokens("ot")} AS ott FROM x1),
x3 AS (SELECT *, CASE WHEN ot IS NULL OR {T.normalized("ot")} = en THEN 0 ELSE {T.clamped(T.rounded(f"(1 - {T.jaccard('et', 'ott')}) * 55") + " + CASE WHEN people > 0 AND inst = 0 THEN 22 ELSE 0 END + CASE WHEN regexp_matches(en, 'owner|owns|bought|acquired') AND NOT regexp_matches(en, 'consortium|group|company') THEN 18 ELSE 0 END + CASE WHEN nd >= 5 THEN 8 ELSE 0 END")} END AS drift FROM x2),
x4 AS (SELECT *, {T.rounded("100.0 / (1.0 + exp(-(-4.2::DOUBLE + materiality * 0.035::DOUBLE + momentum * 0.028::DOUBLE + certainty * 0.011::DOUBLE + least(12, nd) * 0.08::DOUBLE + senior * 0.16::DOUBLE + drift * 0.018::DOUBLE)))")} AS p24 FROM x3),
x5 AS (SELECT *, {T.normalized("headline")} AS hn, array_to_string(list_filter(string_split({T.cleaned("body")}, ' '), lambda c: c <> '')[1:38], ' ') || CASE WHEN len(list_filter(string_split({T.cleaned("body")}, ' '), lambda c: c <> '')) > 38 THEN '…' ELSE '' END AS snippet FROM x4)
SELECT cluster_id, 'live-' || {T.fnv36("hn")} AS event_id, CASE WHEN official THEN {T.filled(P.SUMMARY_OFFICIAL, "lead")} ELSE {T.quoted(P.SUMMARY_COVERAGE[0])} || nd || {T.quoted(P.SUMMARY_COVERAGE[1])} || CASE WHEN nd = 1 THEN '' ELSE 's' END || {T.filled(P.SUMMARY_COVERAGE[2], "lead")} END
  || CASE WHEN snippet <> '' AND NOT contains({T.normalized("snippet")}, substring(hn, 1, 36)) THEN ' ' || snippet ELSE '' END || {T.filled(P.SUMMARY_END, T.quoted(LEXICON.service))} AS summary,
  CASE {" ".join(f"WHEN regexp_matches(hn, {T.quoted(p)}) THEN {T.filled(t, 'lead')}" for p, t in P.WHY)} WHEN momentum >= 65 THEN {T.quoted(P.WHY_MOMENTUM)} WHEN materiality >= 65 THEN {T.filled(P.WHY_MATERIAL, "lead")} ELSE {T.quoted(P.WHY_OTHERWISE)} END AS why,
  sources, 'live-signal headline-derived' || CASE WHEN coalesce(pn, 0) > 0 THEN ' open-public-sentiment' ELSE '' END AS flags, CASE WHEN ot IS NOT NULL AND drift >= 35 THEN CASE WHEN drift >= 72 THEN {T.quoted(P.CLARIFY)} ELSE {T.quoted(P.MONITOR)} END END AS recommendation,
  headline, entity_ids, published_at, updated_at, nd AS source_count, materiality, certainty, momentum, trend_change, tone, drift,
  {T.rounded(T.clamped("p24 * 0.66::DOUBLE + momentum * 0.18::DOUBLE"))} AS p6, p24, {T.rounded(T.clamped("p24 + (100 - p24) * 0.28::DOUBLE"))} AS p72,
  CASE WHEN p24 >= 82 THEN 'ACT NOW' WHEN p24 >= 68 THEN 'PREPARE' WHEN p24 >= 48 THEN 'WATCH' WHEN materiality >= 55 THEN 'AMPLIFY' ELSE 'NO ACTION' END AS posture,
  coalesce(nullif(concat_ws('; ', CASE WHEN momentum >= 65 THEN 'rapid media acceleration' END, CASE WHEN nd >= 5 THEN 'broad independent-source pickup' END, CASE WHEN materiality >= 75 THEN 'high strategic or reputation consequence' END, CASE WHEN certainty < 55 THEN 'uncertainty may drive further coverage' END,
    CASE WHEN senior >= 4 THEN 'promoter or senior-leadership involvement' END, CASE WHEN drift >= 65 THEN 'narrative drift or misattribution risk' END), ''), 'incremental relevance with limited momentum') AS drivers,
  CASE WHEN (materiality >= 76 AND certainty >= 58) OR (immediate AND materiality >= 64) OR (materiality >= 68 AND momentum >= 72 AND certainty >= 50) THEN 'must' WHEN p24 >= 58 OR materiality >= 58 OR (momentum >= 65 AND certainty >= 50) THEN 'watch' ELSE 'other' END AS bucket,
  CASE WHEN official OR certainty >= 82 THEN 'confirmed' WHEN certainty >= 62 THEN 'strong' ELSE 'developing' END AS status, CASE {" ".join(f"WHEN c{i} THEN {T.quoted(n)}" for i, (n, _) in enumerate(LEXICON.categories))} ELSE 'Corporate' END AS category,
  {T.rounded(T.clamped("tone * 0.55::DOUBLE + (materiality - 50) * 0.18::DOUBLE", -100))} AS reputation_impact, greatest(0, 100 - drift) AS narrative_alignment, coalesce({T.rounded("tw::DOUBLE / greatest(gw, 1000000)")}, 0) AS public_score, coalesce(pn, 0) AS public_n FROM x5"""


@query("e8_event_forecasts", _recursive(with_views(_CLUSTERS + _EVERY, "articles", "sources")))
def event_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("public_score", F.coalesce("public_score", F.lit(0)))


@query("d5_attach_public", _recursive(with_views(_CLUSTERS + f""", {T.matches("mx", "articles", "title || ' ' || description")},
nm AS (SELECT ord, entity_id FROM mx WHERE type <> 'stakeholder'),
cm AS (SELECT m.cluster_id, m.ord, k.group_id FROM members m JOIN k USING (ord) JOIN articles a USING (ord) WHERE a.channel <> 'public-conversation'),
pi AS (SELECT k.ord, k.group_id FROM k WHERE public)
SELECT DISTINCT cm.cluster_id, pi.ord FROM pi JOIN near ON near.a = pi.group_id JOIN cm ON cm.group_id = near.b
WHERE EXISTS (SELECT 1 FROM nm p JOIN cm c ON c.cluster_id = cm.cluster_id JOIN nm q ON q.ord = c.ord AND q.entity_id = p.entity_id WHERE p.ord = pi.ord)""", "articles")))
def attach_public(spark: SparkSession, d: str) -> DataFrame:
    rows, groups, pairs, labels = _clustered(spark, d)
    media = labels.join(rows.filter("channel <> 'public-conversation'").select("ord"), "ord")
    found = A.match_entities(rows.select("ord", F.concat_ws(" ", "title", "description").alias("text")), X.entities(spark), LEXICON)
    return C.attach_public(media, rows.filter("channel = 'public-conversation'"), groups, pairs, found)


# Serving over stored events.

_EVENT_ORDER = "CASE bucket WHEN 'must' THEN 3 WHEN 'watch' THEN 2 ELSE 1 END DESC, materiality DESC, updated_at DESC, event_id"


def _served(name: str, f, columns: str, tail: str) -> None:
    query(name, with_views(f"SELECT {columns} FROM served {tail}", "served"))(lambda spark, d: f(X.served(spark, d)).select(*[c.strip() for c in columns.split(",")]))


_served("g2_top_events", lambda e: E.top_events(e), "event_id, bucket, materiality, updated_at", f"ORDER BY {_EVENT_ORDER} LIMIT 60")
_served("g3_trending", lambda e: E.trending(e), "event_id, momentum", "ORDER BY momentum DESC, event_id LIMIT 6")
_served("g5_top_forecasts", lambda e: E.top_forecasts(e), "event_id, p24", "ORDER BY p24 DESC, event_id LIMIT 3")
_served("g6_strongest_narrative", lambda e: E.strongest_narrative(e), "event_id, headline, drift", "ORDER BY drift DESC, event_id LIMIT 1")
_served("g10_latest_events", lambda e: E.latest_events(e, X.now()), "event_id, updated_at", f"WHERE updated_at >= {T.STAMP} - INTERVAL 45 DAYS ORDER BY updated_at DESC, event_id LIMIT 250")
_served("c4_events_in_window", lambda e: E.events_in_window(e, _stamp("2024-01-10 00:00:00"), _stamp("2024-01-12 00:00:00")), "event_id, published_at, updated_at", "WHERE published_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' OR updated_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
_served("c5_material_floor", lambda e: E.material_floor(e), "event_id, materiality", "WHERE materiality >= 35")
_TEXT = T.normalized("concat_ws(' ', headline, summary, why, category, names, flags)")


@query("c6_reduce_noise", with_views(f"SELECT event_id FROM told WHERE NOT regexp_matches({_TEXT}, 'und|que|reputation') OR regexp_matches({_TEXT}, 'strong|nhede')", "served", "told"))
def reduce_noise(spark: SparkSession, d: str) -> DataFrame:
    return E.reduce_noise(X.told(spark, d), "und|que|reputation", "strong|nhede").select("event_id")


@query("g13_brief", with_views("SELECT event_id, bucket AS part, row_number() OVER (PARTITION BY bucket ORDER BY materiality DESC, updated_at DESC, event_id) AS place, count(*) OVER (PARTITION BY bucket) AS n FROM served", "served"))
def brief(spark: SparkSession, d: str) -> DataFrame:
    return E.brief(X.served(spark, d))


@query("b27_reading_time", with_views("""+ w AS (SELECT CAST(sum(len(string_split_regex(summary, '\\s+')) + 14) AS BIGINT) AS words FROM told WHERE bucket IN ('must', 'watch'))
SELECT words, greatest(20, least(120, CAST(floor(words / 3.5 + 0.5) AS INT))) AS seconds FROM w UNION ALL SELECT 0, 12""", "served", "told"))
def reading_time(spark: SparkSession, d: str) -> DataFrame:
    """Of all events, and of none."""
    rows = X.told(spark, d)
    return E.reading_time(rows).union(E.reading_time(rows.filter("bucket IS NULL")))


@query("e6_entity_sentiment", with_views(f"""+ s AS (SELECT entity_id, {T.rounded("sum(tone * greatest(25, materiality))::DOUBLE / sum(greatest(25, materiality))")} AS value, count(*) AS n FROM served WHERE substr(entity_id, 2)::INT % 4 <= 2 AND entity_id <> 'e5' GROUP BY entity_id)
SELECT * FROM s ORDER BY n * 10 + abs(value) DESC, entity_id LIMIT 7""", "served"))
def entity_sentiment(spark: SparkSession, d: str) -> DataFrame:
    rows = X.told(spark, d)
    known = rows.select("entity_id").distinct().filter("entity_id <> 'e5'").withColumn("tier", F.substring("entity_id", 2, 9).cast("int") % 4)
    return E.entity_sentiment(rows, known)


@query("e7_sentiment_rollup", with_views(f"""+ s AS (SELECT sum(tone * sample_size)::DOUBLE AS t, CAST(sum(sample_size) AS BIGINT) AS sample_size, max(event_id % 4)::INT AS channels FROM served WHERE sample_size > 0)
SELECT {T.rounded("t / sample_size")} AS score, sample_size, channels, CASE WHEN sample_size >= 50 AND channels >= 2 THEN 'high' WHEN sample_size >= 12 THEN 'medium' ELSE 'low' END AS confidence FROM s UNION ALL SELECT -1000, 0, 0, 'unavailable'""", "served"))
def sentiment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Of all events, and of those that nobody was asked about; -1000 stands for no score."""
    rows = X.served(spark, d).select(F.col("tone").alias("public_score"), "sample_size", (F.col("event_id") % 4).cast("int").alias("channel_count"))
    return E.sentiment_rollup(rows).union(E.sentiment_rollup(rows.filter("sample_size = 0"))).fillna(-1000, ["score"])


@query("e19_period_compare", with_views(f"""+ p AS (SELECT *, greatest(source_count, event_id % 9 + 1) AS items, published_at BETWEEN TIMESTAMP '2024-01-24' AND {T.STAMP} OR updated_at BETWEEN TIMESTAMP '2024-01-24' AND {T.STAMP} AS cur,
  published_at BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-24' OR updated_at BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-24' AS was FROM served)
SELECT count(*) FILTER (cur) - count(*) FILTER (was) AS developments, count(*) FILTER (cur AND bucket = 'must') - count(*) FILTER (was AND bucket = 'must') AS must,
  CAST(coalesce(sum(items) FILTER (cur), 0) - coalesce(sum(items) FILTER (was), 0) AS BIGINT) AS source_items, {T.rounded("coalesce(avg(tone) FILTER (cur), 0)")} - {T.rounded("coalesce(avg(tone) FILTER (was), 0)")} AS tone FROM p""", "served"))
def period_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = X.served(spark, d).withColumn("sources", F.expr("sequence(0, CAST(event_id % 9 AS INT))"))
    return E.period_compare(rows, _stamp("2024-01-24 00:00:00"), X.now())


@query("e21_watch_status", with_views(f"""+ w AS (SELECT *, published_at BETWEEN TIMESTAMP '2024-01-20' AND {T.STAMP} OR updated_at BETWEEN TIMESTAMP '2024-01-20' AND {T.STAMP} AS changed FROM told WHERE event_id % 10 = 3)
SELECT count(*) FILTER (changed AND watch_state = 'new-update') AS updates, count(*) FILTER (changed AND watch_state IN ('tracking', 'developing', 'case-study')) AS developing,
  count(*) FILTER (NOT changed OR watch_state IN ('stable', 'no-change')) AS stable, count(*) AS total FROM w""", "served", "told"))
def watch_status(spark: SparkSession, d: str) -> DataFrame:
    rows = X.told(spark, d)
    return E.watch_status(rows, rows.filter("event_id % 10 = 3"), _stamp("2024-01-20 00:00:00"), X.now())


@query("h1_union_feeds", with_views("SELECT 0 AS job_idx, ord, title, host FROM articles WHERE ord % 2 = 0 UNION ALL SELECT 2, ord, title, NULL FROM articles WHERE ord % 3 = 0", "articles"))
def union_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Three feeds, of which the second could not be read and the third has no hosts."""
    a = X.articles(spark, d)
    return A.union_feeds(a.filter("ord % 2 = 0").select("ord", "title", "host"), None, a.filter("ord % 3 = 0").select("title", "ord")).select("job_idx", "ord", "title", "host")


@query("h3_priority_union", with_views("SELECT event_id, materiality, CASE WHEN event_id % 3 = 0 THEN 'stored' ELSE 'live' END AS origin FROM served WHERE event_id % 3 = 0 OR event_id % 2 = 0", "served"))
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    rows = X.served(spark, d).select("event_id", "materiality")
    return E.priority_union(rows.filter("event_id % 3 = 0").withColumn("origin", F.lit("stored")), rows.filter("event_id % 2 = 0").withColumn("origin", F.lit("live")))


@query("d17_new_since", with_views("SELECT event_id, materiality FROM served WHERE materiality >= 55 AND event_id % 4 <> 0", "served"))
def new_since(spark: SparkSession, d: str) -> DataFrame:
    rows = X.served(spark, d)
    return E.new_since(rows, rows.filter("event_id % 4 = 0")).select("event_id", "materiality")
