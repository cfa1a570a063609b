"""Line deduplication across documents, in DataFrame operations only.

A line's key is the line stripped of SPACES at both ends with A-Z lower-cased. Keys found in at least min_docs
documents lose all their lines; the others stay in their order, joined by line feeds. A document is a row: a key
counts once for each row that has it.

Each row turns its keys into 128-bit hashes, once for all. Counting shuffles hashes alone, counted before they are
dealt, so a line that stands in every document is one row from each task. To find the places of frequent keys, those
that make up more than a thousandth of all lines (fewer than HOT_SHARE, whatever the input) are broadcast and their places
do not move; only places of other keys are dealt by key. The positions of dropped lines then go to the texts by the
document's key (id and text hash), which no hot line or source can skew. Work grows in proportion to the lines of a text.

Nulls: a null text counts as empty, which is one empty line. Null ids are matched like values. Empty keys never count.
Repeated rows each count and each lose their lines. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.columns import SPACES, ascii_lower, text_or_empty
from evidence_engine.plans.materialize import materialize


#: A key is hot when more than one line in so many has it; so there are fewer hot keys than this.
HOT_SHARE = 1024


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column, min_chars: int) -> Column:
    """For each line the hash of its key, or null where the key is too short to count."""

    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACES))
        return F.when(F.length(key) >= min_chars, F.md5(key))

    return F.transform(_lines(ascii_lower(text)), one)


def frequent_positions(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, body_hash, n_lines, drop) of each distinct (id, text) that loses lines; drop: their positions from 0."""
    body = text_or_empty(F.col("text"))
    hashed = materialize(docs.select("doc_id", F.xxhash64(body).alias("body_hash"), _keys(body, min_chars).alias("keys")))
    counted = hashed.select(F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    frequent = materialize(counted.groupBy("key").count().filter(F.col("count") >= min_docs))
    lines = hashed.agg(F.sum(F.size("keys"))).first()[0] or 0
    is_hot = F.col("count") * HOT_SHARE > lines
    hot, others = frequent.filter(is_hot).select("key"), frequent.filter(~is_hot).select("key")
    placed = hashed.select("doc_id", "body_hash", F.posexplode("keys").alias("at", "key")).filter(F.col("key").isNotNull())
    here = placed.join(F.broadcast(hot), "key", "left_semi")
    dealt = placed.join(F.broadcast(hot), "key", "left_anti").join(others, "key", "left_semi")
    return here.unionByName(dealt).groupBy("doc_id", "body_hash").agg(F.collect_set("at").alias("drop"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines (before), n_dropped, kept_text. Columns of the same names are replaced."""
    drops = frequent_positions(docs, min_docs, min_chars).select(F.col("doc_id").alias("id"), F.col("body_hash").alias("hash"), "drop")
    body = docs.select("doc_id", text_or_empty(F.col("text")).alias("body")).withColumn("body_hash", F.xxhash64("body"))
    joined = body.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body_hash") == F.col("hash")), "left")
    lines = _lines(F.col("body"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    # the lines are a variable of the outer function, so that they are split once
    rest = F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(stay, lambda at: F.get(all_lines, at)), "\n"))
    kept = F.when(F.col("drop").isNull(), F.col("body")).otherwise(rest[0])
    return joined.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text")
    )
