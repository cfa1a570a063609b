"""A governed registry against what was observed: additions, removals, changes of role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import fold

#: Legal forms that do not tell records apart.
_FORMS = r"\b(limited|ltd|incorporated|inc|corporation|corp|plc)\b"


def _plain(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(fold(text), "&", " and "), _FORMS, " ")
    return F.trim(F.regexp_replace(body, "[^a-z0-9]+", " "))


def _side(records: DataFrame, p: str) -> DataFrame:
    """Records with prefixed columns, their normalised title, and the array of names that they go by."""
    own = [F.col(c).cast("string") for c in ("id", "name", "legal_name") if c in records.columns]
    names = F.array(*own) if "aliases" not in records.columns else F.concat(F.array(*own), F.coalesce("aliases", F.array().cast("array<string>")))
    known = F.array_distinct(F.filter(F.transform(names, _plain), lambda a: a != ""))
    order = F.col("ord") if "ord" in records.columns else F.coalesce(F.col("id").cast("string"), F.col("name"))
    return records.select(
        F.coalesce(F.col("id").cast("string"), F.col("name")).alias(f"{p}_key"), order.alias(f"{p}_ord"), F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("title").alias(f"{p}_title"), _plain(F.col("title")).alias(f"{p}_role"), known.alias(f"{p}_names")
    )


def registry_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(change, id, name, from_title, to_title): addition, removal, role_change, unchanged, ambiguous.

    Records(id, name, title; optional legal_name, aliases, ord) meet by any name that they go by. Of several observed records the
    first with the expected title is taken, else the first by the order of the expected names, then of the observed
    records. An observed record serves the first expected one that takes it; others are ambiguous. A role has changed only
    where both titles are known.
    """
    e, o = _side(expected, "e"), _side(observed, "o")
    pairs = e.select("e_key", "e_role", F.posexplode("e_names").alias("nth", "alias")).join(o.select("o_key", "o_ord", "o_role", F.explode("o_names").alias("alias")), "alias")
    other = (F.col("e_role") == "") | (F.col("e_role") != F.col("o_role"))
    taken = pairs.groupBy("e_key").agg(F.min(F.struct(other.alias("other"), "nth", "o_ord", "o_key")).alias("best")).select("e_key", "best.o_key")
    met = e.drop("e_names").join(taken, "e_key", "left")
    first = F.row_number().over(Window.partitionBy("o_key").orderBy("e_ord"))
    met = met.withColumn("nth", F.when(F.col("o_key").isNotNull(), first)).join(o.select("o_key", "o_title", "o_role"), "o_key", "left")
    moved = (F.col("e_role") != "") & (F.col("o_role") != "") & (F.col("e_role") != F.col("o_role"))
    change = F.when(F.col("o_key").isNull(), "removal").when(F.col("nth") > 1, "ambiguous").when(moved, "role_change").otherwise("unchanged")
    to_title = F.when(F.col("nth") == 1, F.col("o_title"))
    rows = met.select(change.alias("change"), F.col("e_id").alias("id"), F.col("e_name").alias("name"), F.col("e_title").alias("from_title"), to_title.alias("to_title"))
    new = o.join(taken.select("o_key").distinct(), "o_key", "left_anti")
    return rows.unionByName(new.select(F.lit("addition").alias("change"), F.col("o_id").alias("id"), F.col("o_name").alias("name"), F.lit(None).cast("string").alias("from_title"), F.col("o_title").alias("to_title")))


def registry_summary(diff: DataFrame) -> DataFrame:
    """One row: how many records of each change, and whether the registry is reconciled."""
    kinds = ("addition", "removal", "role_change", "unchanged", "ambiguous")
    row = diff.agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
    return row.withColumn("reconciled", sum((F.col(k) for k in kinds if k != "unchanged"), F.lit(0)) == 0)
