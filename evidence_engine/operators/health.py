"""Source health: each check against its baseline, with its issues, and a summary with gates for each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.operators.audits import percent


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def source_health(checks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Each check with what it reported, what was expected, whether it failed openly or silently, and its issues in order.

    checks(source_id, check_date, item_count, ok, tier0; optional: status, latency_ms, reconciled, reviewed), baselines(source_id,
    check_date, typical, minimum). A check fails silently when it answers with fewer items than the minimum, fewer than a
    fifth of what is typical, or when the registry that it reads has drifted.
    """
    status, reconciled = _column(checks, "status", "string"), _column(checks, "reconciled", "boolean")
    rows = checks.withColumns({"s": status, "latency": _column(checks, "latency_ms", "double"), "r": reconciled, "seen": _column(checks, "reviewed", "boolean")}).join(baselines, ["source_id", "check_date"], "left")
    least, typical = F.coalesce("minimum", F.lit(0)), F.coalesce("typical", F.lit(0))
    failed = ~F.col("ok") | F.coalesce(F.col("s") == "failed", F.lit(False))
    degraded = ~failed & F.coalesce(F.col("s") == "degraded", F.lit(False))
    below = ~failed & (least > 0) & (F.col("item_count") < least)
    drop = ~failed & (typical > 0) & (F.col("item_count") < F.greatest(least, typical * 0.2))
    drifted = F.coalesce(~F.col("r"), F.lit(False))
    issues = {
        "request_failed": failed, "provider_degraded": degraded, "below_minimum_volume": below, "severe_volume_drop": drop, "registry_drift": drifted,
        "latency_unmeasured": F.coalesce(F.col("latency"), F.lit(0)) == 0, "baseline_unreviewed": ~F.coalesce("seen", F.lit(False)),
    }
    reported = F.coalesce(F.nullif("s", F.lit("")), F.when(~F.col("ok"), F.lit("failed")).otherwise(F.lit("healthy")))
    silent = below | drop | drifted
    return rows.select(
        "source_id", "check_date", "tier0", "item_count", reported.alias("reported"), least.alias("expected_minimum"), typical.alias("expected_typical"), failed.alias("explicit_failure"), silent.alias("silent_failure"),
        (~failed & ~silent & (reported != "degraded")).alias("healthy"), F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in issues.items()])), ",").alias("issues"),
    )


def health_summary(health: DataFrame) -> DataFrame:
    """One row for each day of source_health: counts, shares in percent, failures of tier 0, the four gates."""
    covered = (F.col("expected_minimum") > 0) | (F.col("expected_typical") > 0)
    rows = health.groupBy("check_date").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("healthy").alias("healthy"), F.count_if(F.col("reported") == "degraded").alias("degraded"), F.count_if("explicit_failure").alias("explicit_failures"),
        F.count_if("silent_failure").alias("silent_failures"), F.count_if(covered).alias("baseline_coverage"), F.count_if(F.col("explicit_failure") & F.col("tier0")).alias("tier0_explicit"), F.count_if(F.col("silent_failure") & F.col("tier0")).alias("tier0_silent"),
    )
    rows = rows.withColumns({"success_pct": percent(F.col("healthy"), F.col("checks"), 2), "baseline_pct": percent(F.col("baseline_coverage"), F.col("checks"), 2)})
    return rows.withColumns({"gate_tier0_explicit": F.col("tier0_explicit") == 0, "gate_tier0_silent": F.col("tier0_silent") == 0, "gate_success": F.col("success_pct") >= 90, "gate_baselines": F.col("baseline_coverage") == F.col("checks")})


def tier_health(health: DataFrame) -> DataFrame:
    """Sources, failures and silent failures with and without tier 0."""
    return health.groupBy("tier0").agg(F.countDistinct("source_id").alias("sources"), F.count_if("explicit_failure").alias("failed"), F.count_if("silent_failure").alias("silent"))
