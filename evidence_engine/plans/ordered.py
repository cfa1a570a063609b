"""Order within groups without a group in one task: neighbours in an order, and the first rows of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.plans.materialize import materialize

#: Parts that the rows of one key are dealt to before the best of the parts meet.
SALTS = 32


def _ranges(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def neighbours(rows: DataFrame, group: str, at: str, member: str, ranges: int | None = None) -> DataFrame:
    """rows with before and after: the nearest member (by its at) of the row's group ahead of it and behind it, itself left out.

    rows(group, at, member, ...): at is distinct within a group's members; rows that are no members only ask. The rows are
    cut into ranges by group and order, so a large group lies in many. A range finds neighbours inside; the last and first
    members of the ranges, one row for each group and range, are carried on to the ranges where one is missing. What is
    carried is at most two rows for each range, as only a group that goes on beyond its range needs any.
    """
    n = ranges or _ranges(rows)
    cut = materialize(rows.repartitionByRange(n, group, at).withColumn("__range", F.spark_partition_id()))
    # both look back, one in the opposite order: a frame up to the end is read anew for each row, so a large group would cost its square
    inside, back = (Window.partitionBy(group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in ((F.col(at), F.col(member).desc()), (F.col(at).desc(), F.col(member))))
    own = F.when(F.col(member), F.col(at))
    cut = cut.withColumns({"before": F.last(own, ignorenulls=True).over(inside), "after": F.last(own, ignorenulls=True).over(back)})
    ends = cut.groupBy(group, "__range").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    along = Window.partitionBy(group).orderBy("__range")
    carried = ends.select(
        F.col(group), "__range", F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__high"), F.min("low").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__low")
    ).filter("__high IS NOT NULL OR __low IS NOT NULL")
    both = cut.join(F.broadcast(carried), [group, "__range"], "left")
    return both.withColumns({"before": F.coalesce("before", "__high"), "after": F.coalesce("after", "__low")}).drop("__range", "__high", "__low")


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], most: int, salt: Column, place: str = "place") -> DataFrame:
    """The first rows of each key by a total order, at most so many, with their place from 1.

    Rows are ranked in parts of a key (by the hash of salt) first; only the best of each part meet, so what comes together
    for a key is at most SALTS times most rows, however many it has.
    """
    part = F.pmod(F.xxhash64(salt), F.lit(SALTS))
    near = Window.partitionBy(*key, "__part").orderBy(*order)
    best = rows.withColumn("__part", part).withColumn(place, F.row_number().over(near)).filter(F.col(place) <= most).drop("__part", place)
    return best.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(place) <= most)


def ranks(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], place: str = "place", ranges: int | None = None) -> DataFrame:
    """rows with their place (from 1) within their key by a total order, cut into ranges so that no key is in one task alone.

    Only the sizes of the parts of keys that go on beyond a range are carried, at most one row for each range.
    """
    n = ranges or _ranges(rows)
    cut = materialize(rows.repartitionByRange(n, *key, *order).withColumn("__range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*key, "__range").orderBy(*order)).cast("long")
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*key, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(before)).filter("__before IS NOT NULL").drop("__n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "__range")]
    joined = cut.withColumn(place, inside).alias("a").join(F.broadcast(sizes).alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col(f"a.{place}") + F.coalesce("b.__before", F.lit(0))).alias(place))
