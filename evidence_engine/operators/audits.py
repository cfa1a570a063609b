"""Audits: source health with learned baselines, reliability windows, recall against references, registries, coverage, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import normalize_text
from evidence_engine.operators.articles import small

# Source health.


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent with so many decimals, halves up; 0 where whole is 0."""
    scale = 10**digits
    return F.when(whole > 0, F.floor(part * 100 * scale / whole + 0.5) / scale).otherwise(F.lit(0.0))


def learn_baselines(checks: DataFrame, last: int = 30) -> DataFrame:
    """checks(source_id, check_date, item_count, ok) -> source_id, check_date, typical, minimum after each day.

    Of the last samples, failed ones included in the number: typical is the upper median of the good counts; minimum is half
    of the lowest decile of the good counts above 0, at least 1, once there are five of them, else the one before.
    """
    by = Window.partitionBy("source_id").orderBy("check_date")
    seen = F.collect_list(F.struct("ok", "item_count")).over(by.rowsBetween(-(last - 1), 0))
    good = F.array_sort(F.transform(F.filter("seen", lambda x: x["ok"]), lambda x: x["item_count"]))
    rows = checks.withColumn("seen", seen).withColumn("good", good).withColumn("some", F.filter("good", lambda x: x > 0))
    typical = F.when(F.size("good") > 0, F.get("good", F.floor(F.size("good") / 2).cast("int")))
    floor_ = F.when(F.size("some") >= 5, F.greatest(F.lit(1), F.floor(F.get("some", F.floor(F.size("some") * 0.1).cast("int")) * 0.5)).cast("long"))
    rows = rows.withColumn("typical", typical).withColumn("floor", floor_)
    return rows.select("source_id", "check_date", "typical", F.last("floor", ignorenulls=True).over(by).alias("minimum"))


# Reliability.


def pass_streak(ledger: DataFrame) -> DataFrame:
    """Islands of consecutive passing days; the row that ends last is the current one."""
    days = ledger.filter("pass").select("day").distinct()
    # the ledger has one row for each day, so one window over it is small
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    rows = days.withColumn("island", island).groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    return rows.select("first_day", "last_day", "days")


WEIGHTS = {"critical": 4, "high": 3, "medium": 2, "low": 1}


#: The fields in which a system event may name the references that it stands for.
REFERENCE_FIELDS = ("reference_id", "reference_ids", "matches", "matched_reference_ids", "benchmark_reference_ids")


def _reference_id(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def reference_ids(events: DataFrame) -> DataFrame:
    """(event_id, ref_id): the distinct references of each event, trimmed and lower-cased, from whichever REFERENCE_FIELDS it has; each may be one value or an array."""
    named = []
    for c in REFERENCE_FIELDS:
        if c in events.columns:
            one = events.schema[c].dataType.typeName() != "array"
            named.append(F.coalesce(F.array(F.col(c).cast("string")) if one else F.col(c).cast("array<string>"), F.array().cast("array<string>")))
    ids = F.filter(F.transform(F.concat(*named), _reference_id), lambda x: F.coalesce(x, F.lit("")) != "")
    return events.select("event_id", F.explode(F.array_distinct(ids)).alias("ref_id"))


def match_references(references: DataFrame, detections: DataFrame) -> DataFrame:
    """Each reference with whether anything detected it. detections(event_id, ref_id), or events as reference_ids takes them."""
    found = detections if "ref_id" in detections.columns else reference_ids(detections)
    hit = found.select(_reference_id(F.col("ref_id")).alias("__ref")).distinct().withColumn("hit", F.lit(True))
    rows = references.withColumn("__ref", _reference_id(F.col("ref_id"))).join(hit, "__ref", "left")
    return rows.withColumn("detected", F.coalesce("hit", F.lit(False))).drop("hit", "__ref")


def daily_ledger_entries(evaluation: DataFrame, scans: DataFrame) -> DataFrame:
    """An entry for each day: the verdict and metrics of the evaluation (one row of dependability) and what the day's scans did.

    scans(day, query_count, successful, event_count).
    """
    metrics = evaluation.select("pass", "precision", "weighted_recall", "critical_recall")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("query_count", "successful", "event_count")}
    rows = scans.withColumns(counts).crossJoin(F.broadcast(metrics))  # one row
    return rows.select("day", "pass", "precision", "weighted_recall", "critical_recall", "query_count", "successful", F.greatest(F.lit(0), F.col("query_count") - F.col("successful")).alias("failed"), "event_count")


def false_positives(references: DataFrame, detections: DataFrame) -> DataFrame:
    return detections.join(references.select("ref_id"), "ref_id", "left_anti").select("event_id", "ref_id")


# Registries and history.


def effective_date_suggestions(diff: DataFrame, as_of: str) -> DataFrame:
    action = F.when(F.col("change") == "addition", "add").when(F.col("change") == "removal", "close").when(F.col("change") == "role_change", "change_role")
    return diff.withColumn("action", action).filter("action IS NOT NULL").select("action", "id", F.lit(as_of).cast("date").alias("effective"))


def validity_view(relations: DataFrame, at: Column) -> DataFrame:
    """Relations in force at a date: open ends are null."""
    return relations.filter((F.col("effective_from").isNull() | (F.col("effective_from") <= at)) & (F.col("effective_to").isNull() | (F.col("effective_to") > at)))


# Coverage of entities by sources.


def map_sources(entities: DataFrame, sources: DataFrame, least_term: int = 5) -> DataFrame:
    """entity_id, source_id, confidence, matched_by: explicit references count 1; sources without any are matched by name at 0.65.

    entities: entity_id, name; sources: source_id, label, refs (entity ids). Runs of words of a label meet names by equality.
    """
    explicit = sources.select("source_id", F.explode("refs").alias("entity_id")).join(entities.select("entity_id"), "entity_id", "left_semi").select("entity_id", "source_id", F.lit(1.0).alias("confidence"), F.lit("reference").alias("matched_by"))
    rest = sources.filter(F.size("refs") == 0).select("source_id", F.split(normalize_text(F.col("label"), "search"), " ").alias("words"))
    names = entities.select("entity_id", normalize_text(F.col("name"), "search").alias("term")).filter(F.length("term") >= least_term).withColumn("n", F.size(F.split("term", " ")))
    longest = names.agg(F.max("n")).first()[0] or 1

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, n), " "))

    terms = rest.select("source_id", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)])))).alias("term"))
    by_name = terms.join(small(names), "term").groupBy("entity_id", "source_id").agg(F.max("n")).select("entity_id", "source_id", F.lit(0.65).alias("confidence"), F.lit("name").alias("matched_by"))
    return explicit.union(by_name)


def unresolved_references(entities: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.select("source_id", F.explode("refs").alias("entity_id")).join(entities.select("entity_id"), "entity_id", "left_anti")


def _priority_reason() -> Column:
    # The reasons as they appear in reports.
    by_register = (F.col("type") == "person") & F.lower("source_url").contains("leadership")
    return F.when(F.col("official_company"), "official-company-register").when(F.col("family"), "promoter-family").when(F.col("leader"), "significant-leader").when(by_register, "official-leadership-register")


def entity_source_coverage(entities: DataFrame, mapped: DataFrame, sources: DataFrame) -> DataFrame:
    """Each entity with the number of its sources by kind, its gaps, status and priority.

    entities(entity_id, name, type, official_company, family, leader, source_url); mapped as from map_sources; sources(source_id,
    label, kind, tier): a null tier is 0 for official and authoritative ones, else 3. An official, authoritative or tier-0
    source is direct, a query or registry one discovers. covered: both; partial: one of them; gap: none. sources: by tier, label.
    """
    best = mapped.groupBy("entity_id", "source_id").agg(F.max_by("matched_by", "confidence").alias("matched_by"))
    tier = F.coalesce("tier", F.when(F.col("kind").isin("official", "authoritative"), 0).otherwise(3))
    met = best.join(sources.select("source_id", "label", "kind", tier.alias("tier")), "source_id")
    listed = F.array_sort(F.collect_list(F.struct("tier", "label", "source_id")))
    per = met.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if((F.col("tier") == 0) | F.col("kind").isin("official", "authoritative")).alias("direct"), F.count_if(F.col("kind") == "authoritative").alias("authoritative"),
        F.count_if(F.col("kind") == "official").alias("official"), F.count_if(F.col("kind").isin("query", "registry")).alias("discovery"), F.array_join(F.array_sort(F.collect_set("matched_by")), ",").alias("methods"),
        F.array_join(F.transform(listed, lambda x: x["source_id"].cast("string")), ",").alias("sources"),
    )
    numbers = {"n_sources": 0, "direct": 0, "authoritative": 0, "official": 0, "discovery": 0, "methods": "", "sources": ""}
    rows = entities.withColumn("priority_reason", _priority_reason()).join(per, "entity_id", "left").fillna(numbers)
    direct, found, reason = F.col("direct") > 0, F.col("discovery") > 0, F.col("priority_reason")
    # The gaps as they appear in reports.
    gaps = {
        "no-direct-tier-0-source": ~direct,
        "no-discovery-or-media-map": ~found,
        "no-direct-authoritative-adapter": reason.isNotNull() & (F.col("authoritative") == 0) & (F.col("type") == "company"),
    }
    status = F.when(direct & found, "covered").when(direct | found, "partial").otherwise("gap")
    named = F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in gaps.items()])
    return rows.select("entity_id", "name", "type", reason.isNotNull().alias("priority"), "priority_reason", status.alias("status"), *numbers, named.alias("gaps"))


def coverage_summary(coverage: DataFrame, mapped: DataFrame, sources: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: entities by status, all and those of priority, sources, mappings and unresolved references."""
    states = ("covered", "partial", "gap")
    row = coverage.agg(
        F.count(F.lit(1)).alias("entities"), *[F.count_if(F.col("status") == s).alias(s) for s in states],
        F.count_if("priority").alias("priority"), *[F.count_if(F.col("priority") & (F.col("status") == s)).alias(f"priority_{s}") for s in states],
    )
    counts = {"sources": sources, "mappings": mapped.select("entity_id", "source_id").distinct(), "unresolved": unresolved.distinct()}
    for name, table in counts.items():
        row = row.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # tables of one row
    return row.withColumn("percent", F.coalesce(percent(F.col("priority_covered"), F.col("priority"), 1), F.lit(0.0)))


def filter_coverage(coverage: DataFrame, status: str | None = None, type: str | None = None, priority: bool | None = None, gap: str | None = None, search: str | None = None) -> DataFrame:
    """Filters that are given apply; search is a part of the name or id, in any case."""
    for column, value in (("status", status), ("type", type), ("priority", priority)):
        if value not in (None, ""):
            coverage = coverage.filter(F.col(column) == F.lit(value))
    if gap:
        coverage = coverage.filter(F.array_contains(F.split("gaps", ","), gap))
    needle = (search or "").strip().lower()
    return coverage.filter(F.lower(F.concat_ws(" ", "name", "entity_id")).contains(needle)) if needle else coverage


# Freshness of stored runs.


def freshness_verdict(runs: DataFrame, column: str, limit_minutes: int, now: Column, skew_seconds: int = 60) -> DataFrame:
    """runs with age_minutes and verdict: invalid (no time), future (beyond the skew), stale (older than the limit), fresh."""
    if not 30 <= limit_minutes <= 1440:
        raise ValueError("the limit must lie between 30 and 1440 minutes")
    ms = F.unix_millis(now) - F.unix_millis(F.col(column))
    verdict = F.when(F.col(column).isNull(), "invalid").when(ms < -1000 * skew_seconds, "future").when(ms > limit_minutes * 60_000, "stale").otherwise("fresh")
    return runs.withColumns({"age_minutes": F.greatest(F.lit(0), F.floor(ms / 60_000)), "verdict": verdict})


def coverage_policy(runs: DataFrame, end: Column, max_lag_minutes: int = 90) -> DataFrame:
    """runs(window_start, window_end, ...) against a requested end: complete, trailing (allowed lag) or incomplete, and the lag."""
    lag = F.greatest(F.lit(0), F.ceil((F.unix_millis(end) - F.unix_millis("window_end")) / 60_000))
    return runs.withColumn("lag_minutes", lag).withColumn("coverage", F.when(F.col("lag_minutes") == 0, "complete").when(F.col("lag_minutes") <= max_lag_minutes, "trailing").otherwise("incomplete"))


def latest_run(runs: DataFrame, by: str = "ingested_at") -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct(by, "run_id")).alias("r")).select("r.*")


def quality_rules(events: DataFrame, known_entities: DataFrame) -> DataFrame:
    """(rule, event_id) of each violation of the stored events: fields, enumerations, lengths, addresses, ranges, references.

    events(event_id, headline, summary, why, bucket, status, category, published_at, updated_at, entity_ids, sources
    array<struct<url>>, materiality, certainty, momentum, narrative_alignment, tone). A summary has 60 to 100 words. An event
    counts once for each unknown entity and each bad address.
    """
    fields = ("headline", "summary", "why", "bucket", "status", "category", "published_at", "updated_at")
    n = F.size(F.split(F.trim(F.coalesce("summary", F.lit(""))), r"\s+"))
    sources = F.coalesce("sources", F.array().cast(events.schema["sources"].dataType))

    def outside(c: str, low: int, high: int) -> Column:
        return ~F.coalesce(F.col(c).between(low, high), F.lit(False))

    rules = {
        **{f"{c}_missing": F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in fields},
        "bucket": ~F.coalesce(F.col("bucket").isin("must", "watch", "other"), F.lit(False)),
        "status": ~F.coalesce(F.col("status").isin("confirmed", "strong", "developing"), F.lit(False)),
        "summary_length": (n < 60) | (n > 100),
        "no_source": F.size(sources) == 0,
        **{f"{c}_range": outside(c, 0, 100) for c in ("materiality", "certainty", "momentum", "narrative_alignment")},
        "tone_range": outside("tone", -100, 100),
        "date_order": F.col("updated_at") < F.col("published_at"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    bad = F.transform(F.filter(sources, lambda x: ~F.coalesce(x["url"].rlike("^https?://"), F.lit(False))), lambda _: F.lit("source_address"))
    single = events.select("event_id", F.explode(F.concat(broken, bad)).alias("rule")).select("rule", "event_id")
    twice = events.groupBy("event_id").count().filter("count > 1").select(F.lit("duplicate_id").alias("rule"), "event_id")
    named = events.select("event_id", F.explode("entity_ids").alias("entity_id"))
    unknown = named.join(known_entities.select("entity_id"), "entity_id", "left_anti").select(F.lit("unknown_entity").alias("rule"), "event_id")
    return single.union(twice).union(unknown)
