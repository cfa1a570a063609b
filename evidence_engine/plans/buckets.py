"""A table in buckets by key that batches change one by one: only the buckets that a batch touches are written anew.

Under a path lie data/<write>/bucket=<n>/ and manifest/. A manifest is one file, so it is there as a whole or not at all; it
names, for each bucket, the write that holds it. Readers take the manifest of the greatest batch. A batch first writes its
buckets to a folder of their own and then its manifest, so a crash in between leaves the table as it was, and the batch that
comes again starts from the manifest before it. A batch whose manifest is there is not applied again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.plans.merge import merge_table

#: Buckets of a table; a table's own number is in its manifests.
BUCKETS = 64


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch long, bucket int, buckets int, place string").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, int, dict[int, str]] | None:
    """Batch, number of buckets and place of each bucket of the last manifest (before a batch), if there is one."""
    rows = _manifests(spark, path)
    if rows is None:
        return None
    rows = rows.filter(F.col("batch") < before) if before is not None else rows
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    found = rows.filter(F.col("batch") == last).distinct().collect()  # one row for each bucket, and one for the table
    return last, found[0].buckets, {r.bucket: r.place for r in found if r.bucket >= 0}


def _places(path: str, of: dict[int, str], buckets: Sequence[int]) -> list[str]:
    return [f"{path}/data/{of[b]}/bucket={b}" for b in sorted(buckets) if b in of]


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of its last manifest; empty before the first."""
    found = manifest(spark, path)
    places = _places(path, found[2], list(found[2])) if found else []
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upsert(path: str, rows: DataFrame, batch_id: int, key: Sequence[str], buckets: int = BUCKETS, **rules) -> set[int]:
    """Merge a batch (its keys distinct) into the table by merge_table; the buckets that were written."""
    spark = rows.sparkSession
    last = manifest(spark, path)
    if last and last[0] >= batch_id:
        return set()
    n, of = (last[1], last[2]) if last else (buckets, {})
    home = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    new = rows.withColumn("__bucket", home)
    touched = {r[0] for r in new.select("__bucket").distinct().collect()}  # at most as many as there are buckets
    place = f"{batch_id}-{uuid.uuid4().hex}"
    if touched:
        old = _places(path, of, sorted(touched))
        had = spark.read.schema(rows.schema).parquet(*old) if old else spark.createDataFrame([], rows.schema)
        merged = merge_table(had, rows, key, **rules).withColumn("bucket", home)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{place}")
    commit(spark, path, batch_id, n, of | dict.fromkeys(touched, place))
    return touched


def commit(spark: SparkSession, path: str, batch_id: int, buckets: int, of: dict[int, str]) -> None:
    """Write the manifest of a batch: one file. The row of bucket -1 stands for a table that is still empty."""
    rows = [(batch_id, b, buckets, p) for b, p in of.items()] + [(batch_id, -1, buckets, "")]
    spark.createDataFrame(rows, "batch long, bucket int, buckets int, place string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the writes that none of the last manifests names; how many. Not while a batch is being written."""
    rows = _manifests(spark, path)
    if rows is None:
        return 0
    batches = [r.batch for r in rows.select("batch").distinct().orderBy(F.desc("batch")).limit(keep).collect()]
    named = {r.place for r in rows.filter(F.col("batch").isin(batches)).select("place").distinct().collect()}
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName() not in named] if store.exists(folder) else []
    for p in old:
        store.delete(p, True)
    return len(old)
