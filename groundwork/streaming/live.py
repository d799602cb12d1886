"""Live analytics: tumbling answer series, run rollups, rate limits, job retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Span prefix of a pipeline stage, attempts before a job is dead, rate limit.
SPAN_PREFIX = "ingest."
MAX_ATTEMPTS = 5
LIMIT, WINDOW_S = 60, 60.0


def answer_series(spans: DataFrame, bucket: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Answers, cost and latency per tumbling window and level, for append mode."""
    s = spans.where("name = 'answer'").withWatermark("at", lateness)
    g = s.groupBy(F.window("at", bucket).alias("w"), F.coalesce("level", F.lit("?")).alias("level"))
    return g.agg(F.count(F.lit(1)).alias("answers"), F.sum("cost").alias("cost"), F.sum("duration_ms").alias("ms")).select("w.start", "w.end", "level", "answers", "cost", "ms")


def stage_rollup(spans: DataFrame) -> DataFrame:
    """Steps of each run as its spans end (update mode): stage = span name after the prefix.

    A noop counts as skipped; the worst status of a stage wins.
    """
    s = spans.where(F.col("name").startswith(SPAN_PREFIX) & (F.length("name") > len(SPAN_PREFIX)))
    sev = F.when(F.col("status") == "error", 2).when(F.col("status") == "noop", 0).otherwise(1)
    g = s.groupBy("run_id", F.substring("name", len(SPAN_PREFIX) + 1, 200).alias("stage")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.sum("duration_ms"), 2).alias("ms"), F.max(sev).alias("_s")
    )
    return g.withColumn("status", F.element_at(F.array(F.lit("skipped"), F.lit("ok"), F.lit("error")), F.col("_s") + 1)).drop("_s")


def _limiter(limit: int, window_s: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
        ok = []
        for at in rows["at"]:
            if start is None or at - start > window_s:
                start, n = float(at), 1
                ok.append(True)
            elif n >= limit:
                ok.append(False)
            else:
                n += 1
                ok.append(True)
        state.update((float(start), int(n)))
        yield pd.DataFrame({"tenant": key[0], "subject": key[1], "event_id": rows["event_id"].to_numpy(), "at": rows["at"].to_numpy(), "allowed": ok})

    return step


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, window_s: float = WINDOW_S) -> DataFrame:
    """Admission of each event by (tenant, subject); the window starts at the subject's first event.

    The state is two numbers per subject. A micro-batch hands over only its own rows of a subject.
    """
    return events.groupBy("tenant", "subject").applyInPandasWithState(
        _limiter(limit, window_s), "tenant string, subject string, event_id long, at double, allowed boolean", "start double, n long", "append", GroupStateTimeout.NoTimeout
    )


def job_states(log: DataFrame) -> DataFrame:
    """Attempts and last state per job from its event log (job_id, event, at, seq); dead after five attempts."""
    g = log.groupBy("job_id").agg(
        F.count_if(F.col("event") == "leased").alias("attempts"), F.count_if(F.col("event") == "nack").alias("nacks"), F.max_by("event", F.struct("at", "seq")).alias("last_event"), F.max("at").alias("last_at")
    )
    s = F.when(F.col("last_event") == "ack", "done").when(F.col("attempts") >= MAX_ATTEMPTS, "dead").when(F.col("last_event") == "leased", "running").otherwise("ready")
    return g.withColumn("state", s)
