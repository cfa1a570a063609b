"""The feed semantics as Structured Streaming: policy, dedupe, momentum, baselines, visits, upserts, joins, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from evidence_engine.functions.text import canonical_url
from evidence_engine.plans.buckets import BUCKETS, upsert


#: State of several variables needs a store with column families.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Cells that the media items of a token and a pane are dealt to.
CELLS = 4


def _with_state(stream: DataFrame) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return stream


def stream_ingest(stream: DataFrame, column: str = "published_at", late: str = "96 hours", ahead_hours: int = 12) -> DataFrame:
    """Late items fall behind the watermark; items further ahead of the clock than the tolerance, and undated ones, go."""
    soon = F.current_timestamp() + F.expr(f"INTERVAL {ahead_hours} HOURS")
    return stream.filter(F.col(column).isNotNull() & (F.col(column) <= soon)).withWatermark(column, late)


def stream_dedupe(stream: DataFrame) -> DataFrame:
    """The first item of each canonical address within the watermark."""
    return stream.withColumn("item_key", canonical_url(F.col("url"))).dropDuplicatesWithinWatermark(["item_key"])


#: Hours of the spans that momentum looks back over.
SPANS = (6, 12, 24, 48)


def stream_panes(stream: DataFrame, column: str, key: str) -> DataFrame:
    """Items of each key in hours of event time: key, pane (its start), n. The one state that all spans are made from."""
    rows = stream.groupBy(F.window(column, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("pane"), "n")


def momentum_spans(panes: DataFrame, key: str, spans: Sequence[int] = SPANS) -> DataFrame:
    """key, pane, n<hours>...: for each hour with items, those of the last hours that end with it, from panes alone.

    A key has at most one pane an hour, however many items.
    """
    hour = F.col("pane").cast("timestamp").cast("long")
    along = Window.partitionBy(key).orderBy(hour)
    return panes.select(key, "pane", *[F.sum("n").over(along.rangeBetween(-(h - 1) * 3600, 0)).alias(f"n{h}") for h in spans])


class _Baseline(StatefulProcessor):
    """Keeps the last samples of a source; emits typical and minimum after each."""

    def __init__(self, last: int = 30):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "check_date date, item_count long, ok boolean")
        self.floor = handle.getValueState("floor", "minimum long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        have = [tuple(x) for x in self.samples.get()] if self.samples.exists() else []
        floor = self.floor.get()[0] if self.floor.exists() else None
        out = []
        new = pd.concat(list(rows)).sort_values("check_date")
        for day, count, ok in new[["check_date", "item_count", "ok"]].itertuples(index=False):
            have = [*have, (day, int(count), bool(ok))][-self.last :]
            good = sorted(n for _, n, o in have if o)
            some = [n for n in good if n > 0]
            if len(some) >= 5:
                floor = max(1, some[int(len(some) * 0.1)] // 2)
            out.append((key[0], day, good[len(good) // 2] if good else None, floor))
        self.samples.put(have)
        if floor is not None:
            self.floor.update((floor,))
        yield pd.DataFrame(out, columns=["source_id", "check_date", "typical", "minimum"]).astype({"typical": "Int64", "minimum": "Int64"})

    def close(self) -> None:
        pass


def stream_baseline(checks: DataFrame, last: int = 30) -> DataFrame:
    """checks(source_id, check_date, item_count, ok) as a stream -> baselines after each sample. A source's samples must come in order of their days."""
    return _with_state(checks).groupBy("source_id").transformWithStateInPandas(_Baseline(last), "source_id long, check_date date, typical long, minimum long", "append", "none")


def _visits(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a user's visits and events until the watermark has passed a visit; then tells what was new at it. Times are microseconds.

    A call handles all of a user's visits that the watermark has passed; one timer, for the earliest one left, calls again.
    """
    ids, at, visits = (np.array(x, dtype="int64") for x in (state.get if state.exists else ((), (), ())))
    if not state.hasTimedOut:
        new = pd.concat(list(parts))
        mark = new["visit"].to_numpy(dtype=bool)
        times, named = new["at"].to_numpy(dtype="int64"), new["event_id"].to_numpy(dtype="int64")
        ids, at, visits = np.concatenate([ids, named[~mark]]), np.concatenate([at, times[~mark]]), np.union1d(visits, times[mark])
    passed = state.getCurrentWatermarkMs()
    done = visits[visits < passed * 1000]
    if len(done):
        told = at <= done[-1]
        yield pd.DataFrame({"user_id": [key[0]] * int(told.sum()), "event_id": ids[told], "ts": at[told], "visit_at": done[np.searchsorted(done, at[told])]})
        ids, at, visits = ids[~told], at[~told], visits[len(done) :]
    if len(ids) or len(visits):
        state.update((ids.tolist(), at.tolist(), visits.tolist()))
        if len(visits):
            state.setTimeoutTimestamp(max(int(visits[0]) // 1000, passed) + 1)
    elif state.exists:
        state.remove()


def stream_new_since_visit(events: DataFrame, visits: DataFrame, late: str = "96 hours") -> DataFrame:
    """events(user_id, event_id, ts) and visits(user_id, at) as streams -> user_id, event_id, ts, visit_at.

    What was new at a visit is what came after the visit before it. A visit is told of when the watermark has passed it, so
    an event counts for the first visit at or after its own time, whatever batches the two came in. The two inputs are one
    keyed stream with one state. A user's state holds what came since the last visit told.
    """
    columns = ["user_id", "event_id", "ts", "visit"]
    both = events.withColumn("visit", F.lit(False)).select(columns).unionByName(visits.select("user_id", F.lit(0).cast("long").alias("event_id"), F.col("at").alias("ts"), F.lit(True).alias("visit")))
    both = both.filter("ts IS NOT NULL").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    told = both.groupBy("user_id").applyInPandasWithState(_visits, "user_id long, event_id long, ts long, visit_at long", "ids array<long>, at array<long>, visits array<long>", "append", "EventTimeTimeout")
    return told.select("user_id", "event_id", *[F.timestamp_micros(c).alias(c) for c in ("ts", "visit_at")])


def new_since_visit(events: DataFrame, visits: DataFrame) -> DataFrame:
    """The same of two tables: each event with the user's first visit at or after it; events after the last visit are not told."""
    asks = events.select("user_id", "ts", "event_id", F.lit(None).cast("timestamp").alias("visit_at"))
    both = asks.unionByName(visits.select("user_id", F.col("at").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.col("at").alias("visit_at")))
    after = Window.partitionBy("user_id").orderBy("ts", F.col("visit_at").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("visit_at", F.first("visit_at", ignorenulls=True).over(after)).filter("event_id IS NOT NULL AND visit_at IS NOT NULL").select("user_id", "event_id", "ts", "visit_at")


def stream_conversation_attach(media: DataFrame, public: DataFrame, within: str = "24 hours", late: str = "96 hours") -> DataFrame:
    """media(ord, token, published_at), public(item, token, said_at) as streams -> pairs that share a token within a span of time.

    Time is cut into panes as long as the span. An item of media is in one pane and one of CELLS cells, a public one in the
    three panes around its own and in every cell; so each pair meets once, a row is compared with what lies within two
    spans of it alone, and a token that all have runs in a task for each pane and cell.
    """
    width = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {within})")

    def pane(c: str) -> Column:
        at = F.unix_micros(c)
        return at - F.pmod(at, width)

    m = media.withWatermark("published_at", late).withColumn("pane", pane("published_at")).withColumn("cell", F.pmod(F.xxhash64("ord"), F.lit(CELLS)))
    p = public.withWatermark("said_at", late).withColumnRenamed("token", "said_token")
    p = p.withColumn("said_pane", F.explode(F.array(*[pane("said_at") + k * width for k in (-1, 0, 1)]))).withColumn("said_cell", F.explode(F.array(*[F.lit(k).cast("long") for k in range(CELLS)])))
    near = F.expr(f"token = said_token AND pane = said_pane AND cell = said_cell AND said_at BETWEEN published_at - INTERVAL {within} AND published_at + INTERVAL {within}")
    return m.join(p, near).select("ord", "item", "token")


def stream_source_health(checks: DataFrame, baselines: DataFrame) -> DataFrame:
    """A stream of checks against a table of baselines (source_id, typical, minimum): failed or weak checks."""
    rows = checks.join(baselines, "source_id", "left")
    verdict = F.when(~F.col("ok"), "failed").when(F.col("item_count") < F.coalesce("minimum", F.lit(0)), "below_minimum").when(F.col("item_count") < F.col("typical") * 0.2, "degraded")
    return rows.withColumn("alert", verdict).filter("alert IS NOT NULL").select("source_id", "check_date", "item_count", "alert")


def upsert_batches(path: str, key: list[str], buckets: int = BUCKETS, **rules) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge each batch into the bucketed table under path, once for each batch id (see plans/buckets.py).

    Of rows of one key in a batch the greatest, column by column, counts, so that a rerun gives the same table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        new = batch.groupBy(*key).agg(F.max(F.struct(*rest)).alias("last")).select(*key, "last.*").select(*batch.columns)
        upsert(path, new, batch_id, key, buckets, **rules)

    return run


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote; in complete mode the table after the last batch."""
    if mode == "complete":

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        spark = stream.sparkSession
        last = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out").agg(F.max("batch")).first()[0]
        return spark.read.schema(stream.schema).parquet(f"{path}/out/batch={last}")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
