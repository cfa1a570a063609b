"""The driver tables bound to the shapes that the operators read: articles, sources, checks, claims and so on.

Each view exists twice: as a DataFrame function here and as DuckDB SQL in SQL, under the same name and with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.params import Params

NOW = "2024-01-31 00:00:00"

#: Lexicons for the invented syllables of the test tables.
LEXICON = Params(
    stop_words=["the", "and", "der", "des", "que", "und", "die", "les"],
    canonical={"thanea.": "thanea"},
    positive=["attion", "thanea", "reedes", "und"],
    negative=["thanedble", "therhean", "der", "que"],
    materiality={"eriner": 28, "attion": 20, "thanea": 18, "que": 12, "die": 10},
    certainty_up=["the"],
    certainty_down=["thble"],
    context_phrase="eriner",
    domain_tiers=[],
)

#: id, name, type, tier, parent, ambiguous.
ENTITIES = [
    ("e_group", "eriner", "group", 0, None, False),
    ("e_one", "thanedble", "company", 0, "e_group", False),
    ("e_two", "tion", "company", 1, "e_group", False),
    ("e_three", "reedes", "brand", 2, "e_one", False),
    ("e_four", "therhean", "person", 0, "e_group", True),
    ("e_five", "attion", "person", 1, "e_one", False),
    ("e_six", "laleeneelle", "company", 1, "e_group", False),
    ("e_stake", "esndha", "stakeholder", 2, None, False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def entities(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*e, k) for k, e in enumerate(ENTITIES)], "entity_id string, name string, type string, tier int, parent_id string, ambiguous boolean, position int")
    return rows.withColumn("aliases", F.array("name")).withColumn("context", F.array().cast("array<string>"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.trim("text"), r"\s+")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.array_join(F.slice(words, 1, 12), " ").alias("title"),
        F.array_join(F.slice(words, 13, F.greatest(F.size(words), F.lit(1))), " ").alias("description"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/a/"), F.col("doc_id").cast("string"), F.lit("?utm_source=x")).alias("url"),
        F.concat(F.lit("www."), "source", F.lit(".example.com")).alias("host"),
        F.expr(f"timestampadd(HOUR, -CAST((doc_id * 7) % 720 AS INT), TIMESTAMP '{NOW}')").alias("published_at"),
        F.when(F.col("doc_id") % 5 == 0, "public-conversation").otherwise("news").alias("channel"),
        F.col("lang").alias("language"),
        F.col("source").alias("source_name"),
        (F.col("n_chars") % 100).alias("engagement"),
        (F.col("doc_id") % 10 == 1).alias("official"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    first = a.select(F.lit(0).alias("job_idx"), F.col("ord").alias("item_idx"), "title", "url", "published_at")
    again = a.filter("ord % 3 = 0").select(F.lit(1).alias("job_idx"), F.col("ord").alias("item_idx"), "title", F.regexp_replace("url", r"\?.*$", "?ref=y").alias("url"), "published_at")
    return first.unionByName(again)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_replace("source", "src", "").cast("int")
    return table(spark, sf_dir, "documents").select("source").distinct().select(n.alias("registry_ord"), F.concat("source", F.lit(".example.com")).alias("domain"), F.col("source").alias("name"), (n % 4).alias("tier"))


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events, their scores taken from the documents' ids and lengths."""
    m = F.col("n_chars") % 101
    bucket = F.when(m >= 76, "must").when(m >= 58, "watch").otherwise("other")
    stamp = "timestampadd(HOUR, -CAST((doc_id * 7) % 720 AS INT), TIMESTAMP '{}')".format(NOW)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("event_id"),
        F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 12), " ").alias("headline"),
        bucket.alias("bucket"),
        m.cast("int").alias("materiality"),
        (F.col("doc_id") * 13 % 101).cast("int").alias("certainty"),
        (F.col("doc_id") * 29 % 101).cast("int").alias("momentum"),
        (F.col("doc_id") * 17 % 101).cast("int").alias("p24"),
        (F.col("doc_id") * 31 % 201 - 100).cast("int").alias("tone"),
        (F.col("doc_id") * 7 % 101).cast("int").alias("drift"),
        (F.col("n_chars") % 7 + 1).cast("int").alias("source_count"),
        (F.col("doc_id") % 23).cast("int").alias("sample_size"),
        F.when(F.col("doc_id") * 13 % 101 >= 82, "confirmed").when(F.col("doc_id") * 13 % 101 >= 62, "strong").otherwise("developing").alias("status"),
        F.concat(F.lit("e"), (F.col("doc_id") % 9).cast("string")).alias("entity_id"),
        F.col("source").alias("source"),
        F.expr(stamp).alias("published_at"),
        F.expr(f"timestampadd(HOUR, CAST(n_chars % 30 AS INT), {stamp})").alias("updated_at"),
    )


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events with their texts, sources and entities: some without summary or source, some with bad addresses, scores out of range or unknown entities."""
    k, words = F.col("doc_id"), F.split(F.trim("text"), r"\s+")
    texts = table(spark, sf_dir, "documents").select(k.alias("event_id"), F.array_join(F.slice(words, F.lit(13), (k % 90 + 20).cast("int")), " ").alias("summary"))
    e, address = F.col("event_id"), F.concat(F.lit("https://e"), (F.col("event_id") % 40).cast("string"), F.lit(".example.com/"), F.col("source"))
    day = F.expr("CAST(CAST(date_sub(CAST(published_at AS DATE), CAST(event_id % 5 AS INT)) AS TIMESTAMP) AS STRING)")
    first = F.struct(F.when(e % 31 == 0, "ftp://bad").otherwise(address).alias("url"), F.lit("first").alias("name"), F.when(e % 4 == 0, "not a date").otherwise(day).alias("published_at"))
    second = F.struct(F.concat(F.lit("https://all.example.com/"), F.col("source")).alias("url"), F.lit("second").alias("name"), F.lit(None).cast("string").alias("published_at"))
    sources = F.when(e % 37 == 0, F.array().cast("array<struct<url:string,name:string,published_at:string>>")).otherwise(F.array(first, second))
    return served(spark, sf_dir).join(texts, "event_id").select(
        "*", F.concat(F.lit("Why "), "source").alias("why"), F.when(e % 3 == 0, "Reputation").when(e % 29 != 0, "Corporate").alias("category"), F.concat(F.lit("name of "), "entity_id").alias("names"), F.array("status", "bucket").alias("flags"),
        sources.alias("sources"), F.array("entity_id", F.concat(F.lit("x"), (e % 2).cast("string"))).alias("entity_ids"), (e * 3 % 105).cast("int").alias("narrative_alignment"),
        F.element_at(F.array(*[F.lit(x) for x in ("new-update", "tracking", "developing", "case-study", "stable", "no-change")]), (e % 6 + 1).cast("int")).alias("watch_state"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of sources from nations, and of parent domains from regions, in that order."""
    k = F.col("n_nationkey")
    kinds = F.array(*[F.lit(x) for x in ("official", "regulator", "major-media", "regional", "", "ratings")])
    own = table(spark, sf_dir, "nation").select(k.alias("registry_ord"), F.concat(F.lit("s"), (k * 2).cast("string"), F.lit(".example.com")).alias("domain"), F.col("n_name").alias("name"), (k % 4).cast("int").alias("tier"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("class"), (k % 9 != 0).alias("active"))
    r = F.col("r_regionkey")
    parents = table(spark, sf_dir, "region").select((r + 100).alias("registry_ord"), F.when(r == 0, "example.com").otherwise(F.concat(F.lit("r"), r.cast("string"), F.lit(".org"))).alias("domain"), F.col("r_name").alias("name"), F.lit(2).alias("tier"), F.lit("specialist-media").alias("class"), F.lit(True).alias("active"))
    return own.unionByName(parents)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("source_id"), F.to_date("ts").alias("check_date")).agg(
        F.count_if(F.col("event_type") != "error").alias("item_count"), (F.count_if(F.col("event_type") == "error") < F.count(F.lit(1))).alias("ok"), (F.first("user_id") % 10 == 0).alias("tier0")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return e.select(
        F.col("event_id").alias("obs_id"), F.col("user_id").alias("event_key"), F.col("event_type").alias("platform"), (F.floor("value").cast("int") % 201 - 100).alias("tone_score"),
        F.get_json_object("props", "$.k").cast("int").alias("engagement_count"), F.col("ts").alias("published_at"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderkey") % 5 == 0, "interpretation").otherwise("fact").alias("kind"),
        F.col("o_orderdate").alias("observed_at"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("observed").alias("lifecycle"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/"), F.col("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("evidence_id"),
        (F.col("l_suppkey") % 4).cast("int").alias("tier"), F.when(F.col("l_linenumber") == 3, "ftp://bad").otherwise(s).alias("url"),
    )


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from orders with their sources from lines: addresses in several fields, some bad, some repeated with another name, dates and tiers missing."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    source = F.struct(
        n.alias("nth"),
        F.when(n % 4 == 0, F.lit("")).when((n % 4 == 3) | (F.col("l_orderkey") % 7 == 0), "ftp://bad").otherwise(F.concat(F.lit("https://s"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".example.com/"), k, F.lit("?utm_source=x&id=1#top"))).alias("url"),
        F.when((n % 4 == 0) & (F.col("l_orderkey") % 7 != 0), F.concat(F.lit("https://link.example.com/"), k)).alias("link"),
        F.when(n % 2 == 1, F.concat(F.lit("A"), (F.col("l_suppkey") % 3).cast("string"))).alias("authority"),
        F.when(n != 6, F.concat(F.lit("N"), (F.col("l_suppkey") % 3).cast("string"))).alias("name"),
        F.when(n % 2 == 1, F.col("l_shipdate").cast("date").cast("string")).alias("published_at"),
        F.when(n % 3 != 0, (F.col("l_suppkey") % 4).cast("int")).alias("tier"),
        (n == 6).alias("official"),
    )
    sources = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    o = F.col("o_orderkey")
    text = F.concat(F.lit("Order "), o.cast("string"), F.lit(" is "), "o_orderpriority")
    facts = F.when(o % 4 == 0, F.array(F.lit("Stated twice"), F.lit("Stated twice"), F.lit(""), text))
    return table(spark, sf_dir, "orders").join(sources, F.col("l_orderkey") == o, "left").select(
        o.alias("event_id"), F.concat(F.lit("Order "), o.cast("string")).alias("headline"), F.concat(F.lit("Order "), o.cast("string")).alias("title"),
        F.when(o % 3 == 0, F.concat(F.lit("https://events.example.com/"), o.cast("string"))).alias("url"), F.col("o_orderdate").cast("date").cast("string").alias("published_at"),
        F.when(o % 4 == 1, F.concat(text, F.lit(" see https://x.example.com/a now."))).otherwise("").alias("summary"), facts.alias("facts"),
        F.when(o % 5 == 0, F.array(F.lit("It may grow"), F.lit(None).cast("string"), F.lit("Or not"))).alias("interpretations"), F.array(F.concat(F.lit("e"), (o % 9).cast("string")), F.lit("e1")).alias("entity_ids"),
        F.when(o % 6 == 0, "closed").alias("lifecycle"), F.when(o % 2 == 0, "confirmed").alias("status"), "sources",
    )


def reference_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("ref_id"), kind.alias("materiality"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(key.alias("event_id"), F.when(key % 11 == 0, F.lit(-1)).otherwise(key).alias("ref_id"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.withColumn("pass", F.col("errors") * 100 < F.col("n") * 21)


def registry_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("role"), F.col("s_nationkey").cast("string")).alias("title"))


def registry_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("s_suppkey") % 11 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 17 <> 0").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" Ltd")).alias("name"), F.concat(F.lit("role"), role.cast("string")).alias("title"))
    new = table(spark, sf_dir, "nation").filter("n_nationkey < 3").select((F.col("n_nationkey") + 1000000).alias("id"), F.concat(F.lit("New "), "n_name").alias("name"), F.lit("role0").alias("title"))
    return known.unionByName(new)


_STAMP = f"TIMESTAMP '{NOW}' - to_hours(CAST((doc_id * 7) % 720 AS INTEGER))"

SQL: dict[str, str] = {
    "entities": "SELECT * FROM (VALUES " + ", ".join(str(tuple(x if x is not None else "" for x in e)) for e in ENTITIES) + ") t(entity_id, name, type, tier, parent_id, ambiguous)",
    "articles": rf"""SELECT doc_id AS ord, array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 1, 12), ' ') AS title,
        array_to_string((string_split_regex(trim(text), '\s+'))[13:], ' ') AS description,
        'https://www.' || source || '.example.com/a/' || doc_id || '?utm_source=x' AS url, 'www.' || source || '.example.com' AS host,
        {_STAMP} AS published_at, CASE WHEN doc_id % 5 = 0 THEN 'public-conversation' ELSE 'news' END AS channel,
        lang AS language, source AS source_name, n_chars % 100 AS engagement, doc_id % 10 = 1 AS official FROM documents""",
    "raw_items": r"""SELECT 0 AS job_idx, ord AS item_idx, title, url, published_at FROM articles
        UNION ALL SELECT 1, ord, title, regexp_replace(url, '\?.*$', '?ref=y'), published_at FROM articles WHERE ord % 3 = 0""",
    "sources": """SELECT CAST(replace(source, 'src', '') AS INTEGER) AS registry_ord, source || '.example.com' AS domain, source AS name,
        CAST(replace(source, 'src', '') AS INTEGER) % 4 AS tier FROM (SELECT DISTINCT source FROM documents)""",
    "served": rf"""SELECT doc_id AS event_id, array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 1, 12), ' ') AS headline,
        CASE WHEN n_chars % 101 >= 76 THEN 'must' WHEN n_chars % 101 >= 58 THEN 'watch' ELSE 'other' END AS bucket,
        CAST(n_chars % 101 AS INT) AS materiality, CAST(doc_id * 13 % 101 AS INT) AS certainty, CAST(doc_id * 29 % 101 AS INT) AS momentum,
        CAST(doc_id * 17 % 101 AS INT) AS p24, CAST(doc_id * 31 % 201 - 100 AS INT) AS tone, CAST(doc_id * 7 % 101 AS INT) AS drift,
        CAST(n_chars % 7 + 1 AS INT) AS source_count, CAST(doc_id % 23 AS INT) AS sample_size,
        CASE WHEN doc_id * 13 % 101 >= 82 THEN 'confirmed' WHEN doc_id * 13 % 101 >= 62 THEN 'strong' ELSE 'developing' END AS status,
        'e' || doc_id % 9 AS entity_id, source, {_STAMP} AS published_at, {_STAMP} + to_hours(CAST(n_chars % 30 AS INTEGER)) AS updated_at FROM documents""",
    "told": r"""SELECT s.*, array_to_string((string_split_regex(trim(d.text), '\s+'))[13:32 + doc_id % 90], ' ') AS summary, 'Why ' || s.source AS why, CASE WHEN event_id % 3 = 0 THEN 'Reputation' WHEN event_id % 29 <> 0 THEN 'Corporate' END AS category,
        'name of ' || entity_id AS names, status || ' ' || bucket AS flags, CASE WHEN event_id % 31 = 0 THEN 'ftp://bad' ELSE 'https://e' || event_id % 40 || '.example.com/' || s.source END AS url1, 'https://all.example.com/' || s.source AS url2, event_id % 37 = 0 AS bare,
        CASE WHEN event_id % 4 <> 0 AND event_id % 37 <> 0 THEN CAST(CAST(published_at AS DATE) - CAST(event_id % 5 AS INT) AS TIMESTAMP) END AS first_date, CAST(event_id * 3 % 105 AS INT) AS narrative_alignment,
        ['new-update', 'tracking', 'developing', 'case-study', 'stable', 'no-change'][event_id % 6 + 1] AS watch_state FROM served s JOIN documents d ON doc_id = event_id""",
    "registry": """SELECT n_nationkey AS registry_ord, 's' || n_nationkey * 2 || '.example.com' AS domain, n_name AS name, CAST(n_nationkey % 4 AS INT) AS tier, ['official', 'regulator', 'major-media', 'regional', '', 'ratings'][n_nationkey % 6 + 1] AS class, n_nationkey % 9 <> 0 AS active FROM nation
        UNION ALL SELECT 100 + r_regionkey, CASE WHEN r_regionkey = 0 THEN 'example.com' ELSE 'r' || r_regionkey || '.org' END, r_name, 2, 'specialist-media', true FROM region""",
    "checks": """SELECT user_id AS source_id, CAST(ts AS DATE) AS check_date, count(*) FILTER (WHERE event_type <> 'error') AS item_count,
        count(*) FILTER (WHERE event_type = 'error') < count(*) AS ok, user_id % 10 = 0 AS tier0 FROM events GROUP BY ALL""",
    "observations": """SELECT event_id AS obs_id, user_id AS event_key, event_type AS platform, CAST(floor(value) AS INTEGER) % 201 - 100 AS tone_score,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS engagement_count, ts AS published_at FROM events WHERE event_type <> 'error'""",
    "claims": """SELECT o_orderkey AS claim_id, o_custkey AS event_id, CASE WHEN o_orderkey % 5 = 0 THEN 'interpretation' ELSE 'fact' END AS kind,
        o_orderdate AS observed_at, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'observed' END AS lifecycle FROM orders""",
    "evidence": """SELECT l_orderkey AS claim_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id, CAST(l_suppkey % 4 AS INT) AS tier,
        CASE WHEN l_linenumber = 3 THEN 'ftp://bad' ELSE 'https://s' || l_suppkey || '.example.com/' || l_orderkey END AS url FROM lineitem""",
    "reported": """SELECT o_orderkey AS event_id, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'https://events.example.com/' || o_orderkey END AS url, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published_at,
        CASE WHEN o_orderkey % 4 = 1 THEN 'Order ' || o_orderkey || ' is ' || o_orderpriority || ' see https://x.example.com/a now.' END AS summary,
        CASE WHEN o_orderkey % 4 = 0 THEN ['Stated twice', 'Stated twice', 'Order ' || o_orderkey || ' is ' || o_orderpriority] END AS facts,
        CASE WHEN o_orderkey % 5 = 0 THEN ['It may grow', 'Or not'] END AS interpretations, CASE WHEN o_orderkey % 6 = 0 THEN 'closed' WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'observed' END AS lifecycle FROM orders""",
    "reporting": """SELECT l_orderkey AS event_id, l_linenumber AS nth, CASE WHEN l_orderkey % 7 = 0 OR l_linenumber % 4 = 3 THEN NULL WHEN l_linenumber % 4 = 0 THEN 'https://link.example.com/' || l_orderkey
        ELSE 'https://s' || l_orderkey % 50 || '.example.com/' || l_orderkey || '?id=1' END AS address, CASE WHEN l_linenumber % 2 = 1 THEN 'A' || l_suppkey % 3 WHEN l_linenumber <> 6 THEN 'N' || l_suppkey % 3 ELSE 'Unknown source' END AS authority,
        CASE WHEN l_linenumber % 2 = 1 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS own_date, CAST(CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey % 4 WHEN l_linenumber = 6 THEN 0 ELSE 3 END AS INT) AS tier, l_linenumber = 6 AS official FROM lineitem""",
    "reference_events": """SELECT o_orderkey AS ref_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS materiality
        FROM orders WHERE o_orderkey % 7 <> 0""",
    "detections": "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey END AS ref_id FROM orders WHERE o_orderstatus <> 'P'",
    "ledger": """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors,
        count(*) FILTER (WHERE event_type = 'error') * 100 < count(*) * 21 AS pass FROM events GROUP BY ALL""",
    "registry_expected": "SELECT s_suppkey AS id, s_name AS name, 'role' || s_nationkey AS title FROM supplier",
    "registry_observed": """SELECT s_suppkey AS id, s_name || ' Ltd' AS name, 'role' || CASE WHEN s_suppkey % 11 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS title FROM supplier WHERE s_suppkey % 17 <> 0
        UNION ALL SELECT 1000000 + n_nationkey, 'New ' || n_name, 'role0' FROM nation WHERE n_nationkey < 3""",
}
SQL["entities"] = SQL["entities"].replace("True", "true").replace("False", "false")


def with_views(query: str, *names: str) -> str:
    """query, with the named views in front as common table expressions."""
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head}{',' if query.lstrip().startswith('+') else ''}\n{query.lstrip().removeprefix('+')}" if names else query
