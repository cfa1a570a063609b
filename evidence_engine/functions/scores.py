"""Scores of articles and events as Column builders. Terms count when the normalised text contains them, each once."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_engine.functions.text import clamp, jaccard, normalize_text, round_half_up, title_tokens, truncate_words
from evidence_engine.params import CLARIFY, COVERAGE_GROUP, DEFAULT, MONITOR, SOURCE_CLASS, SUMMARY_COVERAGE, SUMMARY_END, SUMMARY_OFFICIAL, TIER_CLASS, WHY, WHY_MATERIAL, WHY_MOMENTUM, WHY_OTHERWISE, Params


def _terms(text: Column, weights: dict[str, float]) -> Column:
    return reduce(add, [F.when(text.contains(t), F.lit(w)).otherwise(F.lit(0)) for t, w in weights.items()], F.lit(0))


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def media_tone(normalized: Column, params: Params = DEFAULT, external: Column | None = None) -> Column:
    """7 for each positive term, -8 for each negative; a number given from outside, times 8, goes first."""
    scored = round_half_up(clamp(_terms(normalized, dict.fromkeys(params.positive, 7)) + _terms(normalized, dict.fromkeys(params.negative, -8)), -100, 100))
    if external is None:
        return scored
    number = F.split(F.nullif(external.cast("string"), F.lit("")), ",")[0].try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), round_half_up(clamp(number * 8, -100, 100))).otherwise(scored)


def materiality(normalized: Column, min_tier: Column, n_domains: Column, best_tier: Column, params: Params = DEFAULT) -> Column:
    entity = F.coalesce(F.element_at(F.array(*[F.lit(x) for x in (24, 18, 13, 8, 3, 0)]), F.least(F.coalesce(min_tier, F.lit(4)), F.lit(5)) + 1), F.lit(0))
    breadth = F.least(F.lit(18.0), F.log2(F.greatest(F.lit(1), n_domains).cast("double")) * 7)
    source = F.when(best_tier == 0, 18).when(best_tier == 1, 10).when(best_tier == 2, 5).otherwise(0)
    return round_half_up(clamp(F.lit(8) + _terms(normalized, params.materiality) + entity + breadth + source))


def certainty(normalized: Column, n_domains: Column, best_tier: Column, official: Column, params: Params = DEFAULT) -> Column:
    base = F.when(official | (best_tier == 0), 88).when(best_tier == 1, 68).when(best_tier == 2, 56).otherwise(42)
    spread = F.least(F.lit(8), F.greatest(F.lit(0), n_domains - 1) * 2)
    words = _terms(normalized, dict.fromkeys(params.certainty_up, 4)) + _terms(normalized, dict.fromkeys(params.certainty_down, -6))
    return round_half_up(clamp(base + spread + words))


def forecast(material: Column, momentum: Column, sure: Column, n_sources: Column, seniority: Column, risk: Column) -> Column:
    """struct(p6, p24, p72, drivers, posture)."""
    raw = F.lit(-4.2) + material * 0.035 + momentum * 0.028 + sure * 0.011 + F.least(F.lit(12), n_sources) * 0.08 + seniority * 0.16 + risk * 0.018
    p24 = round_half_up(clamp(F.lit(100.0) / (F.lit(1.0) + F.exp(-raw))))
    rules = [
        (momentum >= 65, "rapid media acceleration"), (n_sources >= 5, "broad independent-source pickup"), (material >= 75, "high strategic or reputation consequence"),
        (sure < 55, "uncertainty may drive further coverage"), (seniority >= 4, "promoter or senior-leadership involvement"), (risk >= 65, "narrative drift or misattribution risk"),
    ]
    drivers = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    drivers = F.when(F.size(drivers) == 0, F.array(F.lit("incremental relevance with limited momentum"))).otherwise(drivers)
    posture = F.when(p24 >= 82, "ACT NOW").when(p24 >= 68, "PREPARE").when(p24 >= 48, "WATCH").when(material >= 55, "AMPLIFY").otherwise("NO ACTION")
    return F.struct(
        round_half_up(clamp(p24 * 0.66 + momentum * 0.18)).alias("p6"), p24.alias("p24"), round_half_up(clamp(p24 + (F.lit(100) - p24) * 0.28)).alias("p72"), drivers.alias("drivers"), posture.alias("posture")
    )


def bucket(material: Column, sure: Column, momentum: Column, p24: Column, immediate: Column) -> Column:
    must = ((material >= 76) & (sure >= 58)) | (immediate & (material >= 64)) | ((material >= 68) & (momentum >= 72) & (sure >= 50))
    return F.when(must, "must").when((p24 >= 58) | (material >= 58) | ((momentum >= 65) & (sure >= 50)), "watch").otherwise("other")


def narrative_drift(headline: Column, official: Column, people: Column, institutions: Column, n_sources: Column, params: Params = DEFAULT) -> Column:
    """struct(score, risk, reasons): how far a headline has moved from the official one."""
    h = normalize_text(headline)
    overlap = jaccard(title_tokens(h, params), title_tokens(normalize_text(official), params))
    personal = (people > 0) & (institutions == 0)
    owned = h.rlike("owner|owns|bought|acquired") & ~h.rlike("consortium|group|company")
    none = official.isNull() | (official == "")
    score = round_half_up((F.lit(1) - overlap) * 55) + F.when(personal, 22).otherwise(0) + F.when(owned, 18).otherwise(0) + F.when(n_sources >= 5, 8).otherwise(0)
    score = F.when(none, F.lit(0)).otherwise(clamp(score)).cast("int")
    reasons = F.array_compact(F.array(F.when(personal, F.lit("personality is displacing the institutional frame")), F.when(owned, F.lit("ownership is being simplified or misattributed")), F.when(overlap < 0.25, F.lit("emerging headlines differ materially from the verified frame"))))
    return F.struct(score.alias("score"), F.when(score >= 72, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW").alias("risk"), F.when(none, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def status_of(sure: Column, official: Column) -> Column:
    return F.when(official | (sure >= 82), "confirmed").when(sure >= 62, "strong").otherwise("developing")


def infer_category(normalized: Column, params: Params = DEFAULT) -> Column:
    return F.coalesce(*[F.when(normalized.rlike(p), F.lit(name)) for name, p in params.categories], F.lit("Corporate"))


def _filled(template: str, who: Column) -> Column:
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), who, F.lit(after)) if "{}" in template else F.lit(template)


def explain_why(headline: Column, entity: Column, material: Column, momentum: Column, params: Params = DEFAULT) -> Column:
    """Why an event matters: the sentence of the first pattern that its headline fits, else by momentum and materiality."""
    h, who = normalize_text(headline), F.coalesce(entity, F.lit(params.subject))
    by_pattern = F.coalesce(*[F.when(h.rlike(p), _filled(t, who)) for p, t in WHY])
    return F.coalesce(by_pattern, F.when(momentum >= 65, F.lit(WHY_MOMENTUM)).when(material >= 65, _filled(WHY_MATERIAL, who)).otherwise(F.lit(WHY_OTHERWISE)))


def event_summary(title: Column, description: Column, n_domains: Column, official: Column, entity: Column, params: Params = DEFAULT) -> Column:
    """Who reports, the lead's first 38 words unless they repeat its title, and a caution."""
    who = F.coalesce(entity, F.lit(params.subject))
    first, middle, last = SUMMARY_COVERAGE
    coverage = F.concat(F.lit(first), n_domains.cast("string"), F.lit(middle), F.when(n_domains == 1, "").otherwise("s"), _filled(last, who))
    snippet = truncate_words(F.coalesce(description, F.lit("")), 38)
    repeats = normalize_text(snippet).contains(F.substring(normalize_text(title), 1, 36))
    detail = F.when((snippet != "") & ~repeats, F.concat(F.lit(" "), snippet)).otherwise("")
    return F.concat(F.when(official, _filled(SUMMARY_OFFICIAL, who)).otherwise(coverage), detail, _filled(SUMMARY_END, F.lit(params.service)))


def recommendation(drift: Column) -> Column:
    return F.when(drift >= 72, F.lit(CLARIFY)).otherwise(F.lit(MONITOR))


def source_class(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_CLASS.items() for x in kv]), kind), F.lit("discovery"))


def class_from_tier(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == k, F.lit(v)) for k, v in TIER_CLASS.items()], F.lit("discovery-index"))


def coverage_group(kind: Column, tier: Column) -> Column:
    known = F.coalesce(F.nullif(kind, F.lit("")), class_from_tier(tier))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COVERAGE_GROUP.items() for x in kv]), known), F.lit("Other evidence"))


def reputation_impact(tone: Column, material: Column) -> Column:
    return round_half_up(clamp(tone * 0.55 + (material - 50) * 0.18, -100, 100))


def narrative_alignment(drift: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - drift)


def reading_seconds(words: Column) -> Column:
    return F.when(words.isNull() | (words == 0), F.lit(12)).otherwise(F.greatest(F.lit(20), F.least(F.lit(120), round_half_up(words / 3.5))))
