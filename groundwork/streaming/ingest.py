"""Continuous ingestion: change records in, versioned store, dead letters and health out.

The store is an append-only log in batch folders. A batch writes to its own folder with overwrite, so
a batch that is run again after a failure leaves the same rows, and nothing of the existing store is
rewritten. The current state is the latest row per key; ``compact`` folds the log when it has grown.
The checkpoint of the stream is the cursor: a restarted stream goes on after its last full batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.skew import latest
from ..operators.versions import content_hash, stable_id

RECORD = "tenant string, source string, uri string, updated timestamp, deleted boolean, body string"
KEYS = ["tenant", "source", "uri"]


def watch(spark: SparkSession, folder: str, glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Change records as they land in a folder of JSON lines; malformed lines arrive in ``_bad``.

    A record that names no tenant belongs to the tenant ``default``.
    """
    r = spark.readStream.schema(RECORD + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.json(folder).withColumn("tenant", F.coalesce("tenant", F.lit("default")))


def _hashed(records: DataFrame) -> DataFrame:
    return records.withColumn("content_hash", content_hash(F.coalesce("body", F.lit(""))))


def fresh(records: DataFrame, lateness: str) -> DataFrame:
    """Each change once within the watermark: a change that is sent again goes, and so do late rows.

    The change time is part of the key, so a document that returns to an earlier content is kept.
    """
    r = _hashed(records).withWatermark("updated", lateness)
    return r.dropDuplicatesWithinWatermark([*KEYS, "content_hash", "deleted", "updated"])


def storm_dedupe(records: DataFrame, lateness: str) -> DataFrame:
    """One copy of each (tenant, source, uri, content) within the watermark, whatever the number of submissions."""
    r = _hashed(records).withWatermark("updated", lateness)
    return r.dropDuplicatesWithinWatermark([*KEYS, "content_hash", "deleted"])


def split_late(batch: DataFrame, floor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows at or below their source's cursor are late. ``floor``: (tenant, source, cursor)."""
    j = batch.join(floor, ["tenant", "source"], "left")
    late = F.col("cursor").isNotNull() & (F.col("updated") <= F.col("cursor"))
    return j.where(~late).drop("cursor"), j.where(late).drop("cursor")


def _bad() -> Column:
    return F.col("_bad").isNotNull() | F.col("uri").isNull() | F.col("source").isNull() | F.col("tenant").isNull()


def ingest_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Write one micro-batch: last change per key to the log, unreadable rows to the dead letters, one health row."""
    batch = batch.persist()
    try:
        dead = batch.where(_bad())
        dead.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/dead/batch={batch_id}")
        good = batch.where(~_bad()).drop("_bad")
        last = latest(good, KEYS, ["updated", "content_hash"])
        rows = last.withColumn("document_id", stable_id(*[F.col(k) for k in KEYS])).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
        health = batch.agg(
            F.lit(batch_id).alias("batch_id"), F.count(F.lit(1)).alias("records"), F.count_if(_bad()).alias("dead"),
            F.count_if(~_bad() & F.col("deleted")).alias("deletions"), F.max("updated").alias("newest"),
        )
        health.write.mode("overwrite").parquet(f"{root}/health/batch={batch_id}")
    finally:
        batch.unpersist()


def run(records: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Start the stream. ``trigger`` as in ``writeStream.trigger``; default is to drain what is there."""
    w = records.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, root)).option("checkpointLocation", f"{root}/_cursor")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """Latest state per document: live rows only."""
    log = spark.read.option("basePath", f"{root}/log").parquet(f"{root}/log/*")
    return latest(log, KEYS, ["updated", "batch_id"]).where("not deleted")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Fold the log into one folder of latest rows, tombstones included."""
    log = spark.read.option("basePath", f"{root}/log").parquet(f"{root}/log/*")
    latest(log, KEYS, ["updated", "batch_id"]).write.mode("overwrite").parquet(target)


def health(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/health/*")


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/dead/*")
