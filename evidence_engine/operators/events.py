"""Clusters to scored events, and the queries that serve stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import scores as S
from evidence_engine.functions.text import clamp, fnv36, holds, normalize_text, round_half_up
from evidence_engine.operators.articles import small
from evidence_engine.operators.validation import finite
from evidence_engine.params import DEFAULT, Params
from evidence_engine.plans.materialize import materialize
from evidence_engine.plans.ordered import first_per_key, ranks


def hours_before(column: str, now: Column) -> Column:
    return (now.cast("double") - F.col(column).cast("double")) / 3600.0


def lookback(members: DataFrame, now: Column, key: str = "cluster_id") -> DataFrame:
    """Counts of members by age, number of domains. Undated members count nowhere; those ahead of now as new."""
    age = hours_before("published_at", now)

    def within(low: float | None, high: float) -> Column:
        return F.count_if((age <= high) & ((age > low) if low is not None else F.lit(True)))

    return members.groupBy(key).agg(
        within(None, 6).alias("n6"), within(None, 12).alias("n12"), within(12, 24).alias("p12"), within(None, 24).alias("n24"), within(24, 48).alias("p24h"), F.countDistinct(F.nullif("host", F.lit(""))).alias("n_domains")
    )


def momentum(members: DataFrame, now: Column, key: str = "cluster_id") -> DataFrame:
    """key, momentum, trend_change, n_domains."""
    rows = lookback(members, now, key)
    speed = F.when(F.col("p24h") > 0, F.col("n24") / F.col("p24h")).when(F.col("n24") > 1, 2.0).otherwise(1.0)
    score = round_half_up(clamp(F.col("n6") * 10 + F.col("n24") * 3 + F.col("n_domains") * 6 + F.least(F.lit(25.0), speed * 8)))
    change = F.when(F.col("p12") == 0, F.when(F.col("n12") > 0, 100).otherwise(0)).otherwise(round_half_up((F.col("n12") - F.col("p12")) / F.col("p12") * 100)).cast("int")
    return rows.select(key, score.alias("momentum"), change.alias("trend_change"), "n_domains")


def public_sentiment(rows: DataFrame, key: str, tone: Column, engagement: Column, channel: Column, weight_cap: int = 5) -> DataFrame:
    """key, score, sample_size, channels, confidence: tone weighted by 1 + log2(1 + engagement), within [1, weight_cap]."""
    weight = F.greatest(F.lit(1.0), F.least(F.lit(float(weight_cap)), F.lit(1.0) + F.log2(F.lit(1.0) + F.greatest(F.lit(0), F.coalesce(engagement, F.lit(0))))))
    rows = rows.select(key, tone.alias("t"), weight.alias("w"), channel.alias("c")).groupBy(key)
    rows = rows.agg(F.sum(F.round(F.col("t") * F.col("w") * 1e6).cast("long")).alias("tw"), F.sum(F.round(F.col("w") * 1e6).cast("long")).alias("w"), F.count(F.lit(1)).alias("sample_size"), F.countDistinct("c").alias("channels"))
    sure = F.when((F.col("sample_size") >= 25) & (F.col("channels") >= 2), "high").when(F.col("sample_size") >= 8, "medium").otherwise("low")
    return rows.select(key, round_half_up(F.col("tw") / F.greatest(F.col("w"), F.lit(1000000))).alias("score"), "sample_size", "channels", sure.alias("confidence"))


def _bits(text: Column, terms: list[str]) -> list[Column]:
    """Which terms the text contains, as numbers of 60 bits each, so that the terms of a cluster are their bitwise or."""
    out = []
    for start in range(0, max(1, len(terms)), 60):
        flags = [F.when(text.contains(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(terms[start : start + 60])]
        out.append(sum(flags, F.lit(0).cast("long")))
    return out


def _sum_bits(columns: list[str], weights: list[float]) -> Column:
    return sum((F.when(F.col(columns[i // 60]).bitwiseAND(F.lit(1 << (i % 60))) != 0, F.lit(w)).otherwise(F.lit(0)) for i, w in enumerate(weights)), F.lit(0))


def _lexicons(params: Params) -> dict[str, dict[str, float]]:
    """Terms and weights of materiality (m) and certainty (c)."""
    return {"m": dict(params.materiality), "c": {**dict.fromkeys(params.certainty_up, 4), **dict.fromkeys(params.certainty_down, -6)}}


def event_features(articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """articles without description, and what events take from their texts: tone, bits of the terms, immediate, categories.

    A text is normalised once and judged where it is read, so that only numbers go on to joins and groups.
    """
    rows = articles.withColumn("body", normalize_text(F.concat_ws(" ", "title", "description")))
    bits = {f"{k}{i}": c for k, terms in _lexicons(params).items() for i, c in enumerate(_bits(F.col("body"), list(terms)))}
    kinds = {f"cat{i}": holds(F.col("body"), p) for i, (_, p) in enumerate(params.categories)}
    kept = [c for c in articles.columns if c != "description"]
    return rows.select(*kept, S.media_tone(F.col("body"), params).alias("tone"), holds(F.col("body"), params.immediate).alias("immediate"), *[c.alias(n) for n, c in {**bits, **kinds}.items()])


def derive_events(members: DataFrame, matches: DataFrame, tiers: DataFrame, entities: DataFrame, now: Column, params: Params = DEFAULT, texts: DataFrame | None = None) -> DataFrame:
    """Clusters to events. members(cluster_id, ord, title, description, url, host, published_at, channel, official, engagement).

    Instead of the description members may have the columns of event_features; texts(ord, description) then give the
    descriptions of the leads. matches(ord, entity_id, type, tier) are the entities of each article's text, tiers(ord, tier)
    its source's tier. A cluster's terms and entities are those of its media articles, united by partial aggregation; no
    cluster's text is ever gathered. Clusters without media article or non-stakeholder entity give no event. Public items
    count for sentiment only. entities(entity_id, name, position): the first by position that is no stakeholder leads.
    sources are the addresses of the first 16 items, media before public ones, by tier, newest first.
    """
    if texts is None:
        texts, members = members.select("ord", "description"), event_features(members, params)
    rows = members.join(tiers.withColumnRenamed("tier", "source_tier"), "ord").withColumn("public", F.col("channel") == "public-conversation")
    rows = materialize(rows)
    media = rows.filter("not public")
    sets = _lexicons(params)
    columns = [f"{k}{i}" for k, terms in sets.items() for i in range(max(1, -(-len(terms) // 60)))]
    is_official = F.col("official") | (F.col("source_tier") == 0)
    rank = F.struct("source_tier", (-F.coalesce(F.unix_micros("published_at"), F.lit(0))).alias("late"), "ord")
    per = media.groupBy("cluster_id").agg(
        *[F.bit_or(c).alias(c) for c in columns],
        F.min(F.struct(*[rank[c].alias(c) for c in ("source_tier", "late", "ord")], "title")).alias("lead"),
        F.min_by(F.when(is_official, F.col("title")), F.when(is_official, rank)).alias("official_title"),
        F.min_by(F.when(~is_official, F.col("title")), F.when(~is_official, rank)).alias("other_title"),
        F.min("source_tier").alias("best_tier"),
        F.max(is_official).alias("official"),
        F.avg("tone").alias("mean_tone"),
        F.max("immediate").alias("immediate"),
        F.min("published_at").alias("published_at"),
        F.max("published_at").alias("updated_at"),
        *[F.max(f"cat{i}").alias(f"cat{i}") for i in range(len(params.categories))],
    )
    per = per.withColumns({"headline": F.col("lead.title"), "lead_ord": F.col("lead.ord")}).drop("lead")
    per = per.join(texts.select(F.col("ord").alias("lead_ord"), F.col("description").alias("lead_text")), "lead_ord", "left").drop("lead_ord")
    named = media.select("cluster_id", "ord").join(matches.select("ord", "entity_id", "type", F.col("tier").alias("entity_tier")), "ord")
    named = named.join(small(entities.select("entity_id", "name", "position")), "entity_id", "left")
    people = F.when(F.col("type") == "person", F.lit(5) - F.coalesce("entity_tier", F.lit(4))).otherwise(0)
    who = named.groupBy("cluster_id").agg(
        F.min(F.when(F.col("type") != "stakeholder", F.col("entity_tier"))).alias("entity_tier"),
        F.count_if(F.col("type") != "stakeholder").alias("primary"),
        F.max(people).alias("seniority"),
        F.min_by(F.when(F.col("type") != "stakeholder", F.col("name")), F.when(F.col("type") != "stakeholder", F.col("position"))).alias("lead_entity"),
        F.count_if(F.col("type") == "person").alias("people"),
        F.count_if(F.col("type").isin("group", "company", "business")).alias("institutions"),
        F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entity_ids"),
    )
    mood = public_sentiment(rows.filter("public"), "cluster_id", F.col("tone"), F.col("engagement"), F.col("host"))
    mood = mood.select("cluster_id", F.col("score").alias("public_score"), F.col("sample_size").alias("public_n"))
    by = ["public", "source_tier", F.col("published_at").desc(), "ord"]
    first = first_per_key(rows.select("cluster_id", "url", "public", "source_tier", "published_at", "ord"), ["cluster_id"], by, 16, F.col("ord"))
    links = first.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]), " ").alias("sources"))
    events = per.join(who.filter("primary > 0"), "cluster_id").join(momentum(media, now), "cluster_id").join(mood, "cluster_id", "left").join(links, "cluster_id", "left")
    parts = {k: [n for n in columns if n[0] == k] for k in sets}
    weighted, words = list(sets["m"].items()), sets["c"]
    entity = F.element_at(F.array(*[F.lit(x) for x in (24, 18, 13, 8, 3, 0)]), F.least(F.coalesce("entity_tier", F.lit(4)), F.lit(5)) + 1)
    source = F.when(F.col("best_tier") == 0, 18).when(F.col("best_tier") == 1, 10).when(F.col("best_tier") == 2, 5).otherwise(0)
    breadth = F.least(F.lit(18.0), F.log2(F.greatest(F.lit(1), F.col("n_domains")).cast("double")) * 7)
    events = events.withColumn("materiality", round_half_up(clamp(F.lit(8) + _sum_bits(parts["m"], [w for _, w in weighted]) + entity + breadth + source)))
    base = F.when(F.col("official") | (F.col("best_tier") == 0), 88).when(F.col("best_tier") == 1, 68).when(F.col("best_tier") == 2, 56).otherwise(42)
    spread = F.least(F.lit(8), F.greatest(F.lit(0), F.col("n_domains") - 1) * 2)
    events = events.withColumn("certainty", round_half_up(clamp(base + spread + _sum_bits(parts["c"], list(words.values())))))
    other = F.coalesce("other_title", "headline")
    drift = S.narrative_drift(other, F.col("official_title"), F.col("people"), F.col("institutions"), F.col("n_domains"), params)["score"]
    differs = F.col("official_title").isNotNull() & (normalize_text(F.col("official_title")) != normalize_text(other))
    events = events.withColumn("drift", F.when(differs, drift).otherwise(0)).withColumn("tone", round_half_up(F.col("mean_tone")))
    events = events.withColumn("forecast", S.forecast(F.col("materiality"), F.col("momentum"), F.col("certainty"), F.col("n_domains"), F.col("seniority"), F.col("drift")))
    category = F.coalesce(*[F.when(F.col(f"cat{i}"), F.lit(n)) for i, (n, _) in enumerate(params.categories)], F.lit("Corporate"))
    heard, framed = F.coalesce("public_n", F.lit(0)) > 0, F.col("official_title").isNotNull() & (F.col("drift") >= 35)
    return events.select(
        "cluster_id", F.concat(F.lit("live-"), fnv36(normalize_text(F.col("headline")))).alias("event_id"),
        S.event_summary(F.col("headline"), F.col("lead_text"), F.col("n_domains"), F.col("official"), F.col("lead_entity"), params).alias("summary"),
        S.explain_why(F.col("headline"), F.col("lead_entity"), F.col("materiality"), F.col("momentum"), params).alias("why"), F.coalesce("sources", F.lit("")).alias("sources"),
        F.concat(F.lit("live-signal headline-derived"), F.when(heard, " open-public-sentiment").otherwise("")).alias("flags"), F.when(framed, S.recommendation(F.col("drift"))).alias("recommendation"), "headline", "entity_ids", "published_at", "updated_at", F.col("n_domains").alias("source_count"), "materiality", "certainty", "momentum", "trend_change", "tone", "drift",
        F.col("forecast.p6").alias("p6"), F.col("forecast.p24").alias("p24"), F.col("forecast.p72").alias("p72"), F.col("forecast.posture").alias("posture"), F.array_join("forecast.drivers", "; ").alias("drivers"),
        S.bucket(F.col("materiality"), F.col("certainty"), F.col("momentum"), F.col("forecast.p24"), F.col("immediate")).alias("bucket"), S.status_of(F.col("certainty"), F.col("official")).alias("status"),
        category.alias("category"), S.reputation_impact(F.col("tone"), F.col("materiality")).alias("reputation_impact"), S.narrative_alignment(F.col("drift")).alias("narrative_alignment"),
        "public_score", F.coalesce("public_n", F.lit(0)).alias("public_n"),
    )


# Serving: filters, order and summaries over stored events.


def events_in_window(events: DataFrame, start: Column, end: Column) -> DataFrame:
    return events.filter(F.col("published_at").between(start, end) | F.col("updated_at").between(start, end))


def material_floor(events: DataFrame, least: int = 35) -> DataFrame:
    return events.filter(F.col("materiality") >= least)


def event_text(events: DataFrame) -> Column:
    """What a search looks through: headline, summary, reason, category, names (with aliases) and flags, as far as there are such columns."""
    told = [F.col(c) for c in ("headline", "summary", "why", "category", "names") if c in events.columns]
    return normalize_text(F.concat_ws(" ", *told, *[F.array_join("flags", " ") for c in events.columns if c == "flags"]))


def reduce_noise(events: DataFrame, noise: str, keep: str) -> DataFrame:
    """Without events whose text speaks of noise and of nothing to keep."""
    rows = events.withColumn("__text", event_text(events))
    return rows.filter(~F.col("__text").rlike(noise) | F.col("__text").rlike(keep)).drop("__text")


def _order() -> list[Column]:
    weight = F.when(F.col("bucket") == "must", 3).when(F.col("bucket") == "watch", 2).otherwise(1)
    return [weight.desc(), F.col("materiality").desc(), F.coalesce("updated_at", "published_at").desc(), F.col("event_id")]


def top_events(events: DataFrame, n: int = 60) -> DataFrame:
    return events.orderBy(*_order()).limit(n)


def trending(events: DataFrame, n: int = 6) -> DataFrame:
    return events.orderBy(F.col("momentum").desc(), "event_id").limit(n)


def top_forecasts(events: DataFrame, n: int = 3) -> DataFrame:
    return events.orderBy(F.col("p24").desc(), "event_id").limit(n)


def strongest_narrative(events: DataFrame) -> DataFrame:
    return events.agg(F.max_by(F.struct("event_id", "headline", "drift"), F.struct("drift", -F.col("event_id"))).alias("e")).select("e.*")


def latest_events(events: DataFrame, now: Column, days: int = 45, n: int = 250) -> DataFrame:
    kept = events.filter(F.col("updated_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return kept.orderBy(F.col("updated_at").desc(), "event_id").limit(n)


def brief(events: DataFrame) -> DataFrame:
    """Each event with its bucket (must, watch, else other), its place there by the order of events, and the size of the bucket."""
    bucket = F.when(F.col("bucket").isin("must", "watch"), F.col("bucket")).otherwise("other")
    rows = events.withColumn("part", bucket)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # three rows
    placed = ranks(rows.select("event_id", "part", "bucket", "materiality", "updated_at", "published_at"), ["part"], _order())
    return placed.join(F.broadcast(sizes), "part").select("event_id", "part", "place", "n")


def reading_time(events: DataFrame) -> DataFrame:
    """One row: words (of the summaries of must and watch, and 14 for each) and the seconds that they take; 12 without events."""
    words = F.size(F.split(F.coalesce("summary", F.lit("-")), r"\s+")) + 14
    row = events.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("bucket").isin("must", "watch"), words)), F.lit(0)).alias("words"))
    return row.select("words", F.when(F.col("n") == 0, 12).otherwise(F.greatest(F.lit(20), F.least(F.lit(120), round_half_up(F.col("words") / 3.5)))).alias("seconds"))


def entity_sentiment(events: DataFrame, entities: DataFrame, n: int = 7, lowest_tier: int = 2) -> DataFrame:
    """Tone of each entity up to a tier, weighted by max(1, materiality / 25), 25 where there is none; the n most covered.

    events(entity_ids, tone, materiality), entities(entity_id, tier). Ids that no entity has do not count.
    """
    w = F.greatest(F.lit(25), F.coalesce(F.nullif("materiality", F.lit(0)), F.lit(25)))
    named = events.select(F.explode("entity_ids").alias("entity_id"), F.coalesce("tone", F.lit(0)).alias("tone"), w.alias("w"))
    named = named.join(small(entities.filter(F.col("tier") <= lowest_tier).select("entity_id")), "entity_id", "left_semi")
    rows = named.groupBy("entity_id").agg(round_half_up(F.sum(F.col("tone") * F.col("w")) / F.sum("w")).alias("value"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy((F.col("n") * 10 + F.abs("value")).desc(), "entity_id").limit(n)


def sentiment_rollup(events: DataFrame) -> DataFrame:
    """One row over events(public_score, sample_size, channel_count): score, sample_size, channels (the most of one event), confidence."""
    heard = events.filter(F.col("public_score").isNotNull() & (F.col("sample_size") > 0))
    rows = heard.agg(F.sum(F.col("public_score") * F.col("sample_size")).alias("t"), F.coalesce(F.sum("sample_size"), F.lit(0)).alias("sample_size"), F.coalesce(F.max(F.coalesce("channel_count", F.lit(0))), F.lit(0)).alias("channels"))
    sure = F.when(F.col("sample_size") == 0, "unavailable").when((F.col("sample_size") >= 50) & (F.col("channels") >= 2), "high").when(F.col("sample_size") >= 12, "medium").otherwise("low")
    return rows.select(F.when(F.col("sample_size") > 0, round_half_up(F.col("t") / F.col("sample_size"))).alias("score"), "sample_size", "channels", sure.alias("confidence"))


def _occurs(start: Column, end: Column) -> Column:
    return F.coalesce(F.col("published_at").between(start, end), F.lit(False)) | F.coalesce(F.col("updated_at").between(start, end), F.lit(False))


def period_compare(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """This period against the one before it, of the same length, in one scan. An event is in a period if it was published or changed in it.

    The items of an event are source_count or, if that is more, the number of its sources. Mean tones are rounded before they
    are compared.
    """
    before = F.timestamp_seconds(start.cast("long") * 2 - end.cast("long"))
    now_, was = _occurs(start, end), _occurs(before, start)
    items = F.greatest(F.coalesce("source_count", F.lit(0)), F.size("sources")) if "sources" in events.columns else F.coalesce("source_count", F.lit(0))

    def delta(value: Column) -> Column:
        return (F.coalesce(F.sum(F.when(now_, value)), F.lit(0)) - F.coalesce(F.sum(F.when(was, value)), F.lit(0))).cast("long")

    def mean(period: Column) -> Column:
        return round_half_up(F.coalesce(F.avg(F.when(period, F.coalesce("tone", F.lit(0)))), F.lit(0.0)))

    return events.agg(delta(F.lit(1)).alias("developments"), delta((F.col("bucket") == "must").cast("int")).alias("must"), delta(items).alias("source_items"), (mean(now_) - mean(was)).alias("tone"))


def watch_status(events: DataFrame, watched: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row over the watched events (their event_id): updates, developing, stable, total. What did not change in the window is stable."""
    rows = events.join(watched.select("event_id").distinct(), "event_id", "left_semi")
    changed, state = _occurs(start, end), F.col("watch_state")
    return rows.agg(
        F.count_if(changed & (state == "new-update")).alias("updates"), F.count_if(changed & state.isin("tracking", "developing", "case-study")).alias("developing"),
        F.count_if(~changed | state.isin("stable", "no-change")).alias("stable"), F.count(F.lit(1)).alias("total"),
    )


def stored_rows(events: DataFrame, now: Column) -> DataFrame:
    """Accepted events as rows of the store: scores that are finite numbers, else null; when first reported; defaults.

    events(event_id, headline, bucket, status, summary, why, published_at, updated_at, sources array<struct<published_at>>) and,
    as far as there are such columns, lifecycle, category, source_count, the scores materiality, certainty, momentum,
    media_tone, sentiment, public_score, reputation_impact, narrative_alignment, and sample_size, channel_count, confidence.
    First reported is the least date of the sources that is one, else the event's, else now.
    """
    given = set(events.columns)

    def text(c: str, otherwise: Column) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), otherwise) if c in given else otherwise

    def score(*names: str) -> Column:
        return F.coalesce(*[finite(F.col(c)) for c in names if c in given], F.lit(None).cast("double"))

    first = F.array_min(F.transform("sources", lambda s: s["published_at"].try_cast("timestamp")))
    levels = ("unavailable", "low", "medium", "high")
    sure = F.when(F.col("confidence").isin(*levels), F.col("confidence")).otherwise("unavailable") if "confidence" in given else F.lit("unavailable")
    many = F.coalesce(F.nullif(F.col("source_count"), F.lit(0)), F.size("sources")) if "source_count" in given else F.size("sources")
    tone = score("media_tone", "sentiment")
    return events.select(
        "event_id", "headline", "bucket", "status", text("lifecycle", F.when(F.col("status") == "confirmed", "confirmed").otherwise("developing")).alias("lifecycle"), text("category", F.lit("Corporate")).alias("category"), "summary", "why",
        *[score(c).alias(c) for c in ("materiality", "certainty", "momentum")], tone.alias("sentiment"), tone.alias("media_tone"), score("public_score").alias("public_score"),
        *[F.coalesce(score(c), F.lit(0.0)).cast("int").alias(c) for c in ("sample_size", "channel_count")], sure.alias("confidence"), *[score(c).alias(c) for c in ("reputation_impact", "narrative_alignment")],
        many.cast("int").alias("source_count"), F.coalesce(first, "published_at", now).alias("first_reported_at"), F.coalesce("published_at", now).alias("published_at"), F.coalesce("updated_at", now).alias("updated_at"), F.lit(True).alias("is_published"),
    )


def coverage_gaps(events: DataFrame, entities: DataFrame, run: DataFrame, registries: DataFrame) -> DataFrame:
    """kind, n of each gap in the evidence; closed social platforms are always one.

    entities(entity_id, type, tier, coverage_required), run: one row (live_status, provider_errors, public_checks,
    public_succeeded, expected_companies, expected_leadership), registries(reconciled).
    """
    named = events.select(F.explode("entity_ids").alias("entity_id"))
    idle = entities.filter(F.col("coverage_required") & (F.col("tier") <= 1)).join(named, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("idle"))
    counts = entities.agg(F.count_if(F.col("type") == "company").alias("companies"), F.count_if(F.col("type") == "person").alias("leaders"))
    unsure = events.agg(F.count_if((F.col("materiality") >= 70) & (F.col("certainty") < 65)).alias("unsure"))
    changed = registries.agg(F.count_if(~F.col("reconciled")).alias("changed"))
    row = run.crossJoin(counts).crossJoin(idle).crossJoin(unsure).crossJoin(changed)  # tables of one row
    none = F.lit(0)
    kinds = {
        "live_error": F.when(F.col("live_status") == "error", 1).otherwise(none),
        "provider_errors": F.col("provider_errors"),
        "companies_unreconciled": F.when(F.col("companies") != F.col("expected_companies"), F.col("companies")).otherwise(none),
        "leadership_unreconciled": F.when(F.col("leaders") != F.col("expected_leadership"), F.col("leaders")).otherwise(none),
        "registry_changed": F.col("changed"),
        "priority_without_event": F.col("idle"),
        "material_but_uncertain": F.col("unsure"),
        "public_unavailable": F.when((F.col("public_checks") > 0) & (F.col("public_succeeded") == 0), 1).otherwise(none),
        "closed_social": F.lit(1),
    }
    gaps = F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("long").alias("n")) for k, n in kinds.items()])
    return row.select(F.inline(gaps)).filter("n > 0")


def priority_union(*tables: DataFrame) -> DataFrame:
    """The first table that has an id wins."""
    ranked = [t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)]
    every = ranked[0]
    for t in ranked[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("__rank"))
    return every.withColumn("__n", first).filter("__n = 1").drop("__n", "__rank")


def new_since(events: DataFrame, known: DataFrame, least: int = 55) -> DataFrame:
    return events.filter(F.col("materiality") >= least).join(known.select("event_id"), "event_id", "left_anti")
