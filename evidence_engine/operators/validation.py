"""Gates for what comes in: events and public observations, each row with its verdict and, where it fails, the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import round_half_up

BUCKETS = ("must", "watch", "other")
STATUSES = ("confirmed", "strong", "developing")
_WEB = r"(?i)^https?://"


def _problems(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]))


def _verdict(rows: DataFrame, call: str | None, order: str | None, most: int | None) -> DataFrame:
    """accepted or rejected; of the valid rows of one call those beyond the first so many are over_limit."""
    valid = F.size("problems") == 0
    if call is None or most is None:
        return rows.withColumn("verdict", F.when(valid, "accepted").otherwise("rejected"))
    nth = F.sum(valid.cast("long")).over(Window.partitionBy(call).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("nth", nth).withColumn("verdict", F.when(~valid, "rejected").when(F.col("nth") > most, "over_limit").otherwise("accepted")).drop("nth")


def finite(value: Column) -> Column:
    """A number from text or number; null for what is none, or not finite."""
    number = F.nullif(F.trim(value.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def validate_events(events: DataFrame, call: str | None = None, order: str = "event_id", most: int | None = 250) -> DataFrame:
    """events(event_id, headline, summary, why, bucket, status, sources array<struct<url>>) with problems and verdict.

    call: the column that tells which call a row came with; of a call's valid rows the first `most` by order are accepted.
    """
    empty = {f"{c}_missing": F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in ("event_id", "headline", "summary", "why")}
    rules = {
        **empty,
        "bucket": ~F.col("bucket").isin(*BUCKETS),
        "status": ~F.col("status").isin(*STATUSES),
        "no_source": F.size(F.coalesce("sources", F.array().cast(events.schema["sources"].dataType))) < 1,
        "unsafe_source": F.coalesce(F.exists("sources", lambda s: ~F.coalesce(s["url"].rlike(_WEB), F.lit(False))), F.lit(False)),
    }
    return _verdict(events.withColumn("problems", _problems(rules)), call, order, most)


def validate_observations(observations: DataFrame, call: str | None = None, order: str = "source_url", most: int | None = 1000) -> DataFrame:
    """observations(event_id, platform, source_url, tone_score, engagement_count, published_at as text, ...) with problems and verdict.

    tone_score and engagement_count may be text; an absent engagement or date is no fault, one that cannot be read is.
    """
    empty = {f"{c}_missing": F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in ("event_id", "platform", "source_url")}
    engagement, said = finite(F.col("engagement_count")), F.col("published_at").cast("string")
    rules = {
        **empty,
        "unsafe_address": ~F.coalesce(F.col("source_url").rlike(_WEB), F.lit(False)),
        "tone": ~finite(F.col("tone_score")).between(-100, 100),
        "engagement": F.coalesce(engagement < 0, F.lit(False)),
        "date": (F.coalesce(said, F.lit("")) != "") & said.try_cast("timestamp").isNull(),
    }
    return _verdict(observations.withColumn("problems", _problems(rules)), call, order, most)


def observation_rows(accepted: DataFrame) -> DataFrame:
    """Accepted observations in the shape that is stored: whole numbers, a time or null, public unless it says otherwise."""
    return accepted.select(
        F.col("event_id").cast("string").alias("event_id"), "source_url", "platform", F.col("published_at").cast("string").try_cast("timestamp").alias("published_at"),
        round_half_up(finite(F.col("tone_score"))).alias("tone_score"), round_half_up(finite(F.col("engagement_count"))).alias("engagement_count"), F.coalesce("accessible_publicly", F.lit(True)).alias("accessible_publicly"),
    )


def event_materiality(*candidates: Column) -> Column:
    """The first candidate that is a finite number, within 0 and 100; 0 where none is."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(*[finite(c) for c in candidates], F.lit(0.0))))
