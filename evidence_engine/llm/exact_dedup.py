"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Copies are combined in three steps, and each compares the
full content, not only its digest, because the text is part of the grouping key:

1. locally: the partial aggregation in each task keeps one row for each text of its partition;
2. by salt: a digest that a thousandth of all rows or more carry is dealt over many tasks by a salt, all others to one.
   The salt is the number of the task that read the row, so what step 1 combined stays one row, whatever the ids are;
3. globally: the winners of a hot digest's salts are combined. Winners of other digests are final already, so their
   texts do not move again.

Rows find their group by three marks of the content: SHA-256, another 64-bit hash, and the number of bytes. Groups of
texts that differ but agree in the first do not meet. On the way back rows of groups of a thousandth of all rows or more stay
where they are; only the others are dealt by their marks.

Nulls: a null text counts as empty. A null id ranks below every other id. Rows that repeat both id and text form one
group like other copies; one of them is kept. An empty table gives an empty result. A very long text moves as one value, at most
twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.columns import ascii_lower, free_names, text_or_empty
from evidence_engine.plans.materialize import materialize

#: A digest is hot when more than one row in so many carries it; so there are fewer hot digests than this.
HOT_SHARE = 1024


def normalised(text: Column) -> Column:
    return ascii_lower(text_or_empty(text))


#: What tells a text apart on the way from its group back to its rows.
MARKS = ("digest", "mark", "size")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, body (normalised text) and the MARKS of each row."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    return rows.select("doc_id", "body", F.sha2("body", 256).alias("digest"), F.xxhash64("body").alias("mark"), F.octet_length("body").alias("size"))


def duplicate_groups(digests: DataFrame, docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row for each distinct text: MARKS, keep_id (the largest id), group_size.

    digests: slim rows (doc_id, MARKS) of docs, written already. The list of hot digests has fewer than HOT_SHARE rows
    whatever the input, which bounds its broadcast.
    """
    total = digests.count()
    hot = digests.groupBy("digest").count().filter(F.col("count") * HOT_SHARE > total).select("digest", F.lit(True).alias("hot"))
    dealt = _marked(docs).join(F.broadcast(hot), "digest", "left").select(
        *MARKS, "body", "doc_id", F.coalesce("hot", F.lit(False)).alias("hot"), F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0).alias("salt")
    )
    by_salt = dealt.groupBy(*MARKS, "salt", "hot", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # the winners of digests that are not hot are final: their own id stands in for the text as the key
    return (
        by_salt.groupBy(*MARKS, F.when(F.col("hot"), F.col("body")).alias("body"), F.when(~F.col("hot"), F.col("keep_id")).alias("own"))
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select(*MARKS, "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, salts: int = 32) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(_marked(docs).drop("body").withColumn("row", F.monotonically_increasing_id()))
    # of rows that repeat id and text the first stays: an aggregate that combines before it is dealt, like the groups
    first = digests.groupBy(*MARKS).agg(F.max(F.struct("doc_id", (-F.col("row")).alias("before"))).alias("first"))
    groups = materialize(duplicate_groups(digests, docs, salts).join(first.select(*MARKS, (-F.col("first.before")).alias("keep_row")), list(MARKS)))
    # rows of large groups meet their group where they are; such groups are fewer than HOT_SHARE, whatever the input
    large = F.col("group_size") * HOT_SHARE > digests.count()
    here = digests.join(F.broadcast(groups.filter(large)), list(MARKS))
    dealt = digests.join(F.broadcast(groups.filter(large).select(*MARKS)), list(MARKS), "left_anti").join(groups.filter(~large), list(MARKS))
    won = F.col("row") == F.col("keep_row")
    return here.unionByName(dealt).select("doc_id", "keep_id", "group_size", won.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, salts: int = 32) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows that repeat id and text, one."""
    digests = materialize(_marked(docs).drop("body"))
    id_, digest, mark, size, own, first = free_names(docs.columns, "keep_id", *MARKS, "own", "first")
    winners = duplicate_groups(digests, docs, salts).select(F.col("keep_id").alias(id_), *[F.col(m).alias(x) for m, x in zip(MARKS, (digest, mark, size), strict=True)])
    body = normalised(F.col("text"))
    marked = docs.withColumn(own, F.struct(F.sha2(body, 256).alias("digest"), F.xxhash64(body).alias("mark"), F.octet_length(body).alias("size")))
    same = (F.col(f"{own}.digest") == F.col(digest)) & (F.col(f"{own}.mark") == F.col(mark)) & (F.col(f"{own}.size") == F.col(size))
    kept = marked.join(winners, F.col("doc_id").eqNullSafe(F.col(id_)) & same, "left_semi")
    # of rows that repeat id and text one stays
    nth = F.row_number().over(Window.partitionBy("doc_id", own).orderBy("doc_id"))
    return kept.withColumn(first, nth).filter(F.col(first) == 1).select(*docs.columns)
