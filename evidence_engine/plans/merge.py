"""MERGE without a lakehouse: old and new versions of a table joined by key, column by column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import md5
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_table(old: DataFrame, new: DataFrame, key: Sequence[str], insert_only: Sequence[str] = (), sticky: dict[str, str] | None = None) -> DataFrame:
    """Upsert new into old by null-safe key. insert_only columns keep the old row's value; others take the new one's.

    sticky: column -> value that, once reached, stays. Both sides need distinct keys. Null keys are equal to each other.
    """
    columns = old.columns
    on = reduce(and_, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), on, "full_outer")
    has_old, has_new = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()

    def merged(c: str):
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}")
        if c in insert_only:
            return F.when(has_old, o).otherwise(n).alias(c)
        if sticky and c in sticky:
            return F.when(has_old & (o == F.lit(sticky[c])), o).when(has_new, n).otherwise(o).alias(c)
        return F.when(has_new, n).otherwise(o).alias(c)

    return both.select(*[merged(c) for c in columns])


def ingest_gate(store: dict[str, DataFrame], graph: dict[str, DataFrame]) -> DataFrame:
    """rule, violations (0 passes) of a graph before it is merged: its quality, and links whose evidence neither side has."""
    quality = graph["quality"].agg(F.coalesce(F.count_if("publishable"), F.lit(0)).alias("good"), F.coalesce(F.sum("unsupported_material"), F.lit(0)).alias("unsupported"))
    rules = {"not_publishable": (F.col("good") == 0).cast("long"), "unsupported_material": F.col("unsupported").cast("long")}
    known = store["evidence"].select("evidence_id").union(graph["evidence"].select("evidence_id"))
    unknown = graph["links"].join(known, "evidence_id", "left_anti").agg(F.lit("unknown_evidence").alias("rule"), F.count(F.lit(1)).alias("violations"))
    return quality.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("violations")) for k, v in rules.items()]))).union(unknown)


def upsert_claim_graph(store: dict[str, DataFrame], graph: dict[str, DataFrame], commit: str, generated_at: str, manifest: str = "", actor: str = "ingestor", request_id: str | None = None) -> dict[str, DataFrame]:
    """The store's tables with the graph merged in, and an audit row. A graph that the gate refuses raises ValueError and changes nothing.

    Tables: events(event_id, ..., first_run, last_run), evidence and claims alike, links(claim_id, evidence_id, first_run),
    corrections(request_id, ..., evidence_ids, reason, first_run), contradictions(id, ..., status, first_run, last_run) and
    audit(run_id, actor, action, request_id, and a count for each table). The graph has them without runs, and quality(publishable,
    unsupported_material). first_run stays; links that exist stay; a correction changes in its evidence_ids and reason alone; a
    resolved contradiction stays so. Keys are distinct on each side. The run's id follows from commit, time and manifest.
    """
    if not commit or not generated_at:
        raise ValueError("a graph needs the commit and the time that it comes from")
    refused = [r.rule for r in ingest_gate(store, graph).filter("violations > 0").collect()]  # three rules
    if refused:
        raise ValueError(f"the graph is refused: {', '.join(sorted(refused))}")
    run = md5(f"{commit}|{generated_at}|{manifest}".encode()).hexdigest()
    keys = {"events": ["event_id"], "evidence": ["evidence_id"], "claims": ["claim_id"], "links": ["claim_id", "evidence_id"], "corrections": ["request_id"], "contradictions": ["id"]}
    out = {}
    for name, key in keys.items():
        new = graph[name].withColumns({c: F.lit(run) for c in ("first_run", "last_run") if c in store[name].columns})
        fixed = [c for c in store[name].columns if c not in ("evidence_ids", "reason")] if name == "corrections" else ["first_run"]
        out[name] = merge_table(store[name], new, key, insert_only=fixed, sticky={"status": "resolved"} if name == "contradictions" else None)
    row = graph["quality"].agg(F.lit(run).alias("run_id"), F.lit(actor).alias("actor"), F.lit("ingest").alias("action"), F.lit(request_id).cast("string").alias("request_id"))
    for name in keys:
        row = row.crossJoin(graph[name].agg(F.count(F.lit(1)).alias(name)))  # tables of one row
    return out | {"audit": store["audit"].unionByName(row)}
