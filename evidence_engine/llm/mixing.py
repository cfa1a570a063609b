"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in a shuffled order that its id fixes, gets a virtual finish time: the source's tokens up to
and with this document, divided by the source's weight. A source may be read max_epochs times; each further epoch goes
on from the end of the one before. All passes are then ranked by finish time over the whole corpus, and those are taken
whose running total stays within the budget. A source that has been read max_epochs times has no further passes, so its
share goes to the others by their weights: the cut falls at the level of a water-filling, which target() computes.

Running totals at both levels are two-step prefix sums: rows fall into ranges (of the shuffled order within a source,
then of finish time over all), the sums of the ranges are accumulated in a table of about the square root of the
rows, and only the rows within a range are ordered by a window. So neither a source with a third of all rows nor the
global order meets in one task.

Nulls: a null text has size 0; null sources form one source, ranked last; a null id is ordered as the empty string.
Rows of size 0 change no total, so they stay out of the queues and are taken once. Rows that share an id (or have none) are
spread by their texts. Repeated rows each count. An empty table gives an empty result. Of a very long text only its size and
its hash go into the queues. The sources themselves (not their rows) are ordered in one task: tens of thousands are no burden.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.columns import free_names, text_or_empty
from evidence_engine.plans.materialize import materialize


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _mark(doc_id: Column, text: Column, seed: str) -> Column:
    """32 hex digits, of the id and the text, that order the documents within their source."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), text_or_empty(text)))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _mark(F.col("doc_id"), F.col("text"), seed).alias("mark"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """For each source: source, source_size, weight, target, budget.

    Water-filling: with the sources in the order in which they are used up, the first that would not be used up if it
    and those after it shared what is left by weight sets the level. The table has a row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("used_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("used_at", F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("nth", F.row_number().over(order))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("reach", (F.col("budget") - F.col("full")) / F.col("open_weight"))
    )
    level = F.min(F.when(F.col("used_at") > F.col("reach"), F.struct("nth", "reach"))).over(everything)["reach"]
    per = per.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("used_at") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return per.select("source", "source_size", "weight", target.alias("target"), "budget")


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, source_size, target, epochs (times taken), taken (words), mark."""
    sizes = materialize(sized(docs, seed))
    per = materialize(targets(sizes, weights, share, max_epochs))
    queued = sizes.filter("size > 0")
    n = queued.count()
    idle = sizes.filter("size = 0").join(per.select(F.col("source").alias("s"), "source_size", "target"), _same(["source"], ["s"]))
    idle = idle.select("doc_id", "source", "size", "source_size", "target", F.lit(1).alias("epochs"), F.lit(0).cast("long").alias("taken"), "mark")
    if not n:
        return idle
    budget, all_weights = per.agg(F.max("budget"), F.sum("weight")).first()
    ranges = int(n**0.5)

    # within a source: the first 32 bits of the mark, spread evenly, give the range
    marked = queued.withColumn("range", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") * F.lit(ranges) / F.lit(2.0**32)))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("source", "range").agg(F.sum("size").alias("in_range")).withColumn("ahead", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)))
    sums = sums.join(per.withColumnRenamed("source", "s"), _same(["source"], ["s"])).select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead", "source_size", "weight", "target")
    here = Window.partitionBy("source", "range").orderBy("mark", F.col("doc_id").asc_nulls_first(), "size")
    placed = marked.withColumn("nth", F.row_number().over(here)).withColumn("upto", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(sums, _same(["source", "range"], ["s", "r"])).withColumn("upto", F.col("upto") + F.col("ahead")).drop("s", "r", "ahead")

    # over all: bands of finish time, so wide that one holds the passes of about n / ranges documents while no source is used up
    passes = placed.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(max_epochs)])))
    passes = passes.withColumn("finish", (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("weight"))
    passes = materialize(passes.withColumn("band", F.floor(F.col("finish") / F.lit(max(budget, 1.0) / all_weights / ranges))))
    bands = passes.groupBy("band").agg(F.sum("size").alias("in_band"))
    bands = bands.select(F.col("band").alias("b"), F.coalesce(F.sum("in_band").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("band").orderBy("finish", "mark", F.col("doc_id").asc_nulls_first(), "epoch", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = passes.withColumn("total", F.sum("size").over(inside)).join(bands, _same(["band"], ["b"]))
    taken = F.when(F.col("total") + F.col("ahead") <= F.lit(budget), 1).otherwise(0)
    won = ranked.groupBy("doc_id", "source", "range", "nth", "size", "source_size", "target", "mark").agg(F.sum(taken).cast("int").alias("epochs"))
    won = won.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), "mark")
    return won.unionByName(idle)


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as mix() takes them, with all their columns. Options are those of mix()."""
    seed = options.get("seed", "mix")
    report = mix(docs, **options).filter(F.col("epochs") > 0)
    mark, source, size, epochs, m, n, times, copy = free_names(docs.columns, "mark", "of_source", "size", "epochs", "own_mark", "own_size", "times", "copy")
    # rows that repeat id, text and source are alike to mix(); the totals of such rows are dealt to them in any order
    counts = report.groupBy(F.col("mark").alias(mark), F.col("source").alias(source), F.col("size").alias(size)).agg(F.sort_array(F.collect_list("epochs"), asc=False).alias(epochs))
    marked = docs.withColumns({m: _mark(docs["doc_id"], docs["text"], seed), n: n_words(docs["text"])})
    joined = marked.join(counts, (F.col(m) == F.col(mark)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(n) == F.col(size)))
    nth = F.when(F.size(epochs) == 1, 1).otherwise(F.row_number().over(Window.partitionBy(mark, source, size).orderBy("doc_id")))
    joined = joined.withColumn(times, F.get(epochs, nth - 1))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
