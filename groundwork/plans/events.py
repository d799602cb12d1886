"""Streaming queries: the events table read as a stream and drained."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import shared_folder, table
from ..streaming import ingest, live


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a streaming frame to its end into a parquet folder and read that back."""
    root = scratch(spark)
    q = df.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _tenant() -> Column:
    """Users belong to one of two tenants."""
    return F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("tenant")


_K = "json_extract_string(props, '$.k')::BIGINT"


@query("stream_answer_series", "T5", """
WITH e AS (SELECT epoch_us(ts) AS us, event_type AS level, value FROM events), m AS (SELECT max(us) - 600000000 AS wm FROM e)
SELECT (us // 3600000000) * 3600 AS start_s, level, count(*)::BIGINT AS answers, round(sum(value), 2) AS ms FROM e GROUP BY ALL HAVING ((us // 3600000000) + 1) * 3600000000 <= (SELECT wm FROM m)
""".replace("GROUP BY ALL HAVING ((us // 3600000000) + 1)", "GROUP BY us // 3600000000, level HAVING (us // 3600000000 + 1)"))
def stream_answer_series(spark: SparkSession, sf: str) -> DataFrame:
    s = event_stream(spark, sf).select(F.lit("answer").alias("name"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("level"), F.lit(0.0).alias("cost"), F.col("value").alias("duration_ms"))
    out = drain(live.answer_series(s), spark)
    return out.select(F.unix_seconds("start").alias("start_s"), "level", "answers", F.round("ms", 2).alias("ms"))


@query("stream_rate_limit", "T4")
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf).select("event_id", F.lit("t1").alias("tenant"), F.col("user_id").cast("string").alias("subject"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return drain(live.rate_limit_stream(e, 3, 86400.0), spark)


@query("stream_dedupe", "T3 T2", f"""
SELECT DISTINCT event_type AS source, 'u' || user_id AS uri, sha256({_K}::VARCHAR) AS content_hash, value > 100 AS deleted FROM events
""")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf).select(_tenant(), F.col("event_type").alias("source"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uri"), F.col("ts").cast("timestamp").alias("updated"), (F.col("value") > 100).alias("deleted"), F.get_json_object("props", "$.k").alias("body"))
    return drain(ingest.storm_dedupe(e, "60 days"), spark).select("source", "uri", "content_hash", "deleted")


@query("stream_ingest", "T1 T7 T8 V5", f"""
WITH r AS (SELECT event_type AS source, 'u' || user_id AS uri, ts, value > 100 AS deleted, sha256({_K}::VARCHAR) AS h FROM events WHERE {_K} <> 13),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, uri ORDER BY ts DESC, h DESC) = 1) SELECT source, uri, h AS content_hash FROM l WHERE NOT deleted
""")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    e = event_stream(spark, sf)
    k = F.get_json_object("props", "$.k")
    r = e.select(_tenant(), F.col("event_type").alias("source"), F.when(k != "13", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("uri"), F.col("ts").cast("timestamp").alias("updated"), (F.col("value") > 100).alias("deleted"), k.alias("body"), F.lit(None).cast("string").alias("_bad"))
    root = scratch(spark)
    ingest.run(ingest.fresh(r, "60 days"), root).awaitTermination()
    return ingest.current(spark, root).select("source", "uri", "content_hash")


@query("stream_stage_rollup", "T6", """
SELECT user_id::VARCHAR AS run_id, event_type AS stage, count(*)::BIGINT AS count, round(sum(value), 2) AS ms, CASE WHEN bool_or(value > 200) THEN 'error' WHEN bool_or(value > 2) THEN 'ok' ELSE 'skipped' END AS status FROM events GROUP BY ALL
""")
def stream_stage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("run_id"), F.concat(F.lit("ingest."), "event_type").alias("name"), F.col("value").alias("duration_ms"), F.when(F.col("value") > 200, "error").when(F.col("value") <= 2, "noop").otherwise("ok").alias("status"))
    root = scratch(spark)
    out = f"{root}/out"

    def keep(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = live.stage_rollup(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    from ..operators.skew import latest

    log = spark.read.parquet(f"{out}/*")
    return latest(log, ["run_id", "stage"], ["batch_id"]).drop("batch_id")


@query("job_states", "T7", f"""
WITH l AS (SELECT user_id * 100 + {_K} AS job_id, CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'nack' WHEN 'purchase' THEN 'ack' WHEN 'signup' THEN 'leased' ELSE 'nack' END AS ev, epoch_us(ts) AS at_, event_id FROM events),
g AS (SELECT job_id, count(*) FILTER (ev = 'leased') AS attempts, count(*) FILTER (ev = 'nack') AS nacks, arg_max(ev, (at_, event_id)) AS last_event, max(at_) AS last_at FROM l GROUP BY 1)
SELECT job_id, attempts::BIGINT AS attempts, nacks::BIGINT AS nacks, last_event, last_at::BIGINT AS last_at, CASE WHEN last_event = 'ack' THEN 'done' WHEN attempts >= 5 THEN 'dead' WHEN last_event = 'leased' THEN 'running' ELSE 'ready' END AS state FROM g
""")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ev = F.when(F.col("event_type").isin("view", "signup"), "leased").when(F.col("event_type") == "purchase", "ack").otherwise("nack")
    return live.job_states(e.select((F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")).alias("job_id"), ev.alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq")))
