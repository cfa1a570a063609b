"""Coverage of the governed entities by direct sources, authoritative sources and discovery queries: matches, rows, gates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import normalize_text
from evidence_engine.operators.articles import small
from evidence_engine.operators.audits import percent

#: What the kind or tier of a source must hold to count as direct or as authoritative.
DIRECT = "official|regulator|exchange|filing|newsroom|investor|rating|court"
AUTHORITATIVE = "tier 0|tier0|official|regulator|exchange|filing|court|rating"
MONITORED = ("group", "company", "brand", "person")
LEAST_TERM = 4


def _key(text: Column) -> Column:
    return normalize_text(text, "search")


def coverage_matches(entities: DataFrame, corpora: DataFrame) -> DataFrame:
    """(entity_id, corpus_id): entities(entity_id, terms), corpora(corpus_id, corpus, scope).

    An entity matches a corpus whose scope names its id, or that holds one of its terms, of at least LEAST_TERM letters, as
    whole words. Runs of words meet terms by equality.
    """
    terms = entities.select("entity_id", F.explode(F.array_distinct(F.transform(F.concat(F.array(F.col("entity_id")), "terms"), _key))).alias("term"))
    long = terms.filter(F.length("term") >= LEAST_TERM)
    longest = long.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    words = corpora.select("corpus_id", F.split(_key(F.col("corpus")), " ").alias("words"))

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))

    told = words.select("corpus_id", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)])))).alias("term"))
    by_term = told.join(small(long), "term").select("entity_id", "corpus_id")
    named = corpora.select("corpus_id", F.explode(F.transform("scope", _key)).alias("key")).filter("key <> ''")
    by_scope = named.join(small(entities.select("entity_id", _key(F.col("entity_id")).alias("key"))), "key").select("entity_id", "corpus_id")
    return by_term.union(by_scope).distinct()


def source_rows(sources: DataFrame) -> DataFrame:
    """sources(source_id, domain, url, kind, tier, direct, official, registry, authoritative, rights, cadence) -> what each is good for."""
    kind, tier = (_key(F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in order], F.lit(""))) for order in (("kind", "tier"), ("tier", "kind")))
    yes = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("direct", "official", "registry", "authoritative")}
    some = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("url", "domain", "rights", "cadence")}
    return sources.select(
        "source_id", "domain",
        (yes["direct"] | yes["official"] | yes["registry"] | kind.rlike(DIRECT)).alias("direct"),
        (yes["authoritative"] | yes["official"] | yes["registry"] | tier.rlike(AUTHORITATIVE)).alias("authoritative"),
        some["rights"].alias("rights_governed"), (some["url"] & some["cadence"]).alias("operational"),
    )


def _ids(matches: DataFrame, name: str) -> DataFrame:
    return matches.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("corpus_id").cast("string"))), ",").alias(name))


def coverage_rows(entities: DataFrame, sources: DataFrame, queries: DataFrame) -> DataFrame:
    """Each monitored entity with the ids that cover it, its issues, and whether it is covered.

    entities(entity_id, name, type, terms, active, monitor, priority, role_tier, official_company, official_leader,
    effective_from, jurisdiction); sources as in source_rows, with name, label and scope; queries(query_id, label, query,
    description, scope).
    """
    kept = F.coalesce("active", F.lit(True)) & F.coalesce("monitor", F.lit(True)) & (F.coalesce("priority", F.lit("")) != "exclude") & F.col("type").isin(*MONITORED)
    leader = (F.col("type") == "person") & (F.coalesce("official_leader", F.lit(False)) | (F.coalesce("role_tier", F.lit("")) == "group") | F.coalesce("priority", F.lit("")).isin("critical", "high"))
    chosen = entities.filter(kept)
    ask = chosen.select("entity_id", F.concat(F.array("name"), F.coalesce("terms", F.array().cast("array<string>"))).alias("terms"))
    told = sources.select(F.col("source_id").alias("corpus_id"), F.concat_ws(" ", F.col("source_id").cast("string"), "name", "label", "url", "domain", F.array_join("scope", " ")).alias("corpus"), "scope")
    good = source_rows(sources).select(F.col("source_id").alias("corpus_id"), "direct", "authoritative")
    met = coverage_matches(ask, told).join(good, "corpus_id")
    asked = queries.select(F.col("query_id").alias("corpus_id"), F.concat_ws(" ", F.col("query_id").cast("string"), "label", "query", "description", F.array_join("scope", " ")).alias("corpus"), "scope")
    rows = chosen
    for part in (_ids(met.filter("direct"), "direct_ids"), _ids(met.filter("authoritative"), "authoritative_ids"), _ids(coverage_matches(ask, asked), "query_ids")):
        rows = rows.join(part, "entity_id", "left")
    terms = F.filter(F.transform(F.concat(F.array("entity_id", "name"), F.coalesce("terms", F.array().cast("array<string>"))), _key), lambda t: F.length(t) >= 3)
    absent = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rules = {
        "no_direct_source": F.col("direct_ids").isNull(),
        "no_authoritative_source": F.col("authoritative_ids").isNull(),
        "no_discovery_query": F.col("query_ids").isNull(),
        "no_search_terms": F.size(terms) == 0,
        "role_effective_date_missing": (F.col("type") == "person") & absent("effective_from"),
        "jurisdiction_missing": (F.col("type") == "company") & absent("jurisdiction"),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    ids = [F.coalesce(c, F.lit("")).alias(c) for c in ("direct_ids", "authoritative_ids", "query_ids")]
    covered = F.col("direct_ids").isNotNull() & F.col("query_ids").isNotNull()
    company = (F.col("type") == "company") & F.coalesce("official_company", F.lit(False))
    return rows.select("entity_id", "name", "type", company.alias("official_company"), leader.alias("leader"), *ids, F.array_join(issues, ",").alias("issues"), covered.alias("covered"))


def coverage_audit(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: counts and shares over coverage_rows and source_rows, and the five gates."""
    direct, found = F.col("direct_ids") != "", F.col("query_ids") != ""
    n = F.count(F.lit(1))
    a = rows.agg(
        n.alias("entities"), F.count_if("covered").alias("covered"), F.count_if(direct).alias("direct_covered"), F.count_if(found).alias("discovery_covered"),
        F.count_if("official_company").alias("companies"), F.count_if(F.col("official_company") & direct).alias("companies_direct"), F.count_if("leader").alias("leaders"), F.count_if(F.col("leader") & direct).alias("leaders_direct"),
    )
    s = source_rows(sources).agg(
        n.alias("sources"), F.count_if("direct").alias("direct_sources"), F.count_if("authoritative").alias("authoritative_sources"), F.count_if("rights_governed").alias("rights_governed"),
        F.count_if("operational").alias("operational"), F.count_if(F.col("direct") & F.col("operational")).alias("direct_operational"),
    )
    row = a.crossJoin(s)  # two tables of one row
    shares = {"covered_pct": ("covered", "entities"), "direct_pct": ("direct_covered", "entities"), "discovery_pct": ("discovery_covered", "entities"), "companies_pct": ("companies_direct", "companies"), "leaders_pct": ("leaders_direct", "leaders")}
    row = row.withColumns({k: percent(F.col(x), F.col(y), 1) for k, (x, y) in shares.items()})
    every = lambda part, whole: (F.col(whole) > 0) & (F.col(part) == F.col(whole))
    gates = {
        "gate_companies": every("companies_direct", "companies"), "gate_leaders": every("leaders_direct", "leaders"), "gate_discovery": every("discovery_covered", "entities"),
        "gate_rights": every("rights_governed", "sources"), "gate_operational": F.col("direct_operational") == F.col("direct_sources"),
    }
    return row.withColumns(gates)


def coverage_gap_lists(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(gap, id): entities without direct source, authoritative source or query; sources without rights; direct sources without operational data."""
    kinds = {"no_direct_source": "direct_ids", "no_authoritative_source": "authoritative_ids", "no_discovery_query": "query_ids"}
    named = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(k)) for k, c in kinds.items()]))
    lacking = F.array_compact(F.array(F.when(~F.col("rights_governed"), F.lit("no_rights_status")), F.when(F.col("direct") & ~F.col("operational"), F.lit("no_operational_metadata"))))
    return rows.select(F.explode(named).alias("gap"), F.col("entity_id").cast("string").alias("id")).union(source_rows(sources).select(F.explode(lacking).alias("gap"), F.col("source_id").cast("string").alias("id")))


def coverage_order(coverage: DataFrame, n: int = 50) -> DataFrame:
    """The first n rows of a coverage report (priority, status, name, ...) with their rank: priorities first, then by status and name."""
    keys = [F.col("priority").desc(), F.col("status"), F.col("name"), F.col("entity_id")]
    return coverage.orderBy(*keys).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))
