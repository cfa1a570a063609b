"""Rules for researched ownership and leadership records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions.text import canonical_url

#: What a record can rest on, and how ownership can be stated.
BASES = ("filing_snapshot", "historical_snapshot", "webpage_observation")
DIRECTNESS = ("direct", "indirect", "not_specified")
PRECISION = ("exact", "rounded", "not_reported")


def day_of(value: Column, month: bool = True) -> Column:
    """A day from yyyy-mm-dd, or with month the first from yyyy-mm; null for anything else and days that do not exist."""
    whole = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))
    return F.coalesce(whole, F.when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01")).try_cast("date"))) if month else whole


def _absent(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) == ""


def _found(rows: DataFrame, rules: dict[str, Column], column: str) -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return rows.select(F.explode(kinds).alias("rule"), F.col(column).cast("string").alias("record_id"))


def _repeated(rows: DataFrame, rule: str, column: str) -> DataFrame:
    return rows.groupBy(column).count().filter((F.col("count") > 1) | F.col(column).isNull()).select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("record_id"))


def validate_history(records: DataFrame, sources: DataFrame, entities: DataFrame, retrieved_on: str) -> DataFrame:
    """(rule, record_id) of each violation.

    records(id, kind, subject_id, related_id, label, locator, basis, source_ids array, effective_from, effective_to, as_of, directness,
    percentage, precision, previous_id), sources(source_id, url, retrieved_on, published_on), entities(entity_id, type,
    stakeholder_class). Dates are text, as researched; effective ones may be months. A reference to a record whose id repeats is
    valid where one of these makes it so.
    """
    batch = F.lit(retrieved_on)
    who = entities.groupBy("entity_id").agg(F.min("type").alias("type"), F.min("stakeholder_class").alias("cls"))
    subject, related = (who.select(F.col("entity_id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("cls").alias(f"{p}_cls")) for p in ("subject", "related"))
    rows = records.join(subject, "subject_id", "left").join(related, "related_id", "left")
    leads, owns = F.col("kind") == "leadership", F.col("kind") == "ownership"
    start, end, proof = day_of(F.col("effective_from")), day_of(F.col("effective_to")), day_of(F.coalesce("as_of", batch), month=False)
    unknown = F.col("percentage").isNull()
    wrong = F.when(unknown, F.col("precision") != "not_reported").otherwise(~F.col("percentage").between(0, 100) | F.isnan("percentage") | (F.col("precision") == "not_reported"))
    company = (F.col("related_type") == "company") | (owns & F.coalesce(F.col("related_cls") == "joint-venture-partner", F.lit(False)))
    rules = {
        "kind": ~F.coalesce(F.col("kind").isin("ownership", "leadership"), F.lit(False)),
        "entity_reference": F.col("subject_type").isNull() | F.col("related_type").isNull() | (F.col("subject_id") == F.col("related_id")),
        "related_type": ~F.coalesce(company, F.lit(False)),
        "subject_type": ~F.coalesce(F.col("subject_type") == F.when(leads, "person").otherwise("company"), F.lit(False)),
        "claim_context": _absent("label") | _absent("locator") | ~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)),
        "evidence_missing": F.coalesce(F.size("source_ids"), F.lit(0)) < 1,
        "effective_from": F.col("effective_from").isNotNull() & start.isNull(),
        "effective_to": F.col("effective_to").isNotNull() & end.isNull(),
        "as_of": F.col("as_of").isNotNull() & day_of(F.col("as_of"), month=False).isNull(),
        "future_source_date": F.col("as_of") > batch,
        "as_of_missing": (F.col("basis") != "webpage_observation") & _absent("as_of"),
        "effective_after_evidence": start > proof,
        "reversed_tenure": end < start,
        "directness": owns & ~F.coalesce(F.col("directness").isin(*DIRECTNESS), F.lit(False)),
        "precision": owns & ~F.coalesce(F.col("precision").isin(*PRECISION), F.lit(False)),
        "percentage": owns & F.coalesce(wrong, F.lit(True)),
    }
    seen = {
        "source_url": canonical_url(F.col("url"), "https").isNull(),
        "source_retrieval": day_of(F.col("retrieved_on"), month=False).isNull() | (F.col("retrieved_on") > batch),
        "source_publication": F.col("published_on").isNotNull() & (day_of(F.col("published_on"), month=False).isNull() | (F.col("published_on") > F.col("retrieved_on"))),
    }
    named = records.select("id", F.explode("source_ids").alias("source_id")).distinct()
    lost = named.join(sources.select("source_id"), "source_id", "left_anti").select(F.lit("unknown_source").alias("rule"), F.col("id").cast("string").alias("record_id")).distinct()
    prior = records.select(F.col("id").alias("previous_id"), F.struct("subject_id", "related_id", "kind").alias("what"), F.col("as_of").alias("before"))
    chained = records.filter("previous_id IS NOT NULL").join(prior, "previous_id", "left")
    ok = (F.col("previous_id") != F.col("id")) & F.col("what").eqNullSafe(F.struct("subject_id", "related_id", "kind")) & (F.coalesce("before", F.lit("")) != "") & (F.col("before") < F.coalesce("as_of", batch))
    broken = chained.groupBy("id").agg(F.max(F.coalesce(ok, F.lit(False))).alias("ok")).filter("NOT ok").select(F.lit("prior_observation").alias("rule"), F.col("id").cast("string").alias("record_id"))
    parts = [_repeated(entities, "duplicate_entity", "entity_id"), _repeated(sources, "duplicate_source", "source_id"), _repeated(records, "duplicate_id", "id"), _found(rows, rules, "id"), _found(sources, seen, "source_id"), lost, broken]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every
