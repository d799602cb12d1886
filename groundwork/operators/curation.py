"""Curation: modes, scores, review queue, decisions, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import repeat_key_text
from .quality import DUPLICATE_SHARE, READABILITY_REVIEW, STALE_DAYS
from .skew import latest

# Actions of the log and what a resolved review becomes.
ACTIONS = ("ingested", "accepted", "rejected", "deleted", "restored", "auto_kept")
STACKED = ("ingested", "accepted", "rejected", "deleted", "auto_kept")
RESOLUTION = {"accepted": "live", "rejected": "rejected", "deleted": "deleted"}
GLOBAL = "*"


def resolve_mode(sources: DataFrame, settings: DataFrame) -> DataFrame:
    """Source override, else tenant default, else automated: (source, mode)."""
    own = settings.where(F.col("source") != GLOBAL).select("source", F.col("mode").alias("_m"))
    dflt = settings.where(F.col("source") == GLOBAL).agg(F.max("mode").alias("_d"))
    j = sources.join(own, "source", "left").join(dflt, F.lit(True), "left")
    return j.select("source", F.coalesce("_m", "_d", F.lit("automated")).alias("mode"))


def curation_score(q: DataFrame, places: int = 4) -> DataFrame:
    """Eight dimensions and the weighted overall, from the quality signals."""
    n = F.col("passages")
    d = (
        q.withColumn("currency", F.round(1.0 - F.least(F.lit(1.0), F.col("age_days") / STALE_DAYS), 4))
        .withColumn("duplicate_pct", F.when(n > 0, F.round(F.col("duplicate_passages") / n, 4)).otherwise(0.0))
        .withColumn("connectedness", F.round(1.0 - F.col("orphan_ratio"), 4))
        .withColumn("traceability", F.when(n > 0, 1.0).otherwise(0.0))
        .withColumn("depth", F.round(F.least(F.lit(1.0), 0.6 * F.least(F.lit(1.0), n / 8.0) + 0.4 * F.col("coverage")), 4))
    )
    o = (
        0.18 * F.col("depth") + 0.15 * F.col("connectedness") + 0.12 * F.col("traceability") + 0.15 * F.col("readability") + 0.15 * F.col("currency")
        + 0.15 * (1.0 - F.col("duplicate_pct")) + 0.10 * F.when(F.col("contradiction_flags") > 0, 0.0).otherwise(1.0)
    )
    d = d.withColumn("overall", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), o)), places))
    dup = F.col("duplicate_pct") >= DUPLICATE_SHARE
    low = ~dup & (F.col("overall") < 0.35)
    why = F.array_compact(F.array(
        F.when(dup, "duplicate"), F.when(F.col("contradiction_flags") > 0, "contradictions"), F.when(F.col("readability") < READABILITY_REVIEW, "low readability"),
        F.when(F.col("currency") < 0.25, "low currency"), F.when(low, "low overall quality"),
    ))
    return d.withColumn("recommendation", F.when(dup | low, "Delete").otherwise("Keep")).withColumn("why", F.array_join(why, "; "))


def review_id(doc_type: Column, title: Column) -> Column:
    """16 hex digits from type and normalised title."""
    return F.substring(F.sha2(F.concat(F.coalesce(doc_type, F.lit("")), F.lit("\u0000"), repeat_key_text(F.coalesce(title, F.lit("")))), 256), 1, 16)


def latest_action(log: DataFrame) -> DataFrame:
    """Last log row per review id; ties on time go to the later sequence number."""
    return latest(log, ["review_id"], ["ts", "seq"])


def settle(batch: DataFrame, modes: DataFrame, log: DataFrame) -> DataFrame:
    """State of each ingested document: automated stays live without a log row, manual goes to review,
    a review that was resolved before keeps its outcome."""
    last = latest_action(log).select("review_id", F.col("action").alias("_a"))
    j = batch.where(F.col("status").isin("ok", "updated")).join(modes, "source", "left").join(last, "review_id", "left")
    done = F.when(F.col("_a") == "accepted", "live").when(F.col("_a") == "rejected", "rejected").when(F.col("_a") == "deleted", "deleted")
    manual = F.coalesce("mode", F.lit("automated")) == "manual"
    state = F.when(~manual, "live").otherwise(F.coalesce(done, F.lit("review")))
    return j.withColumn("state", state).withColumn("log_action", F.when(manual & done.isNull(), "ingested")).drop("_a")


def apply_decisions(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents after the latest decision per document.

    ``decisions``: (document_id, decision, ts, seq); accept and restore make it live, reject and
    delete take it out, authoritative and not_authoritative set the flag, keep changes nothing.
    """
    state = latest(decisions.where(F.col("decision").isin("accept", "reject", "delete", "restore", "keep")), ["document_id"], ["ts", "seq"]).select("document_id", F.col("decision").alias("_s"))
    flag = latest(decisions.where(F.col("decision").isin("authoritative", "not_authoritative")), ["document_id"], ["ts", "seq"]).select("document_id", F.col("decision").alias("_f"))
    j = documents.join(state, "document_id", "left").join(flag, "document_id", "left")
    st = F.when(F.col("_s").isin("accept", "restore"), "live").when(F.col("_s") == "reject", "rejected").when(F.col("_s") == "delete", "deleted").otherwise(F.col("state"))
    au = F.when(F.col("_f") == "authoritative", True).when(F.col("_f") == "not_authoritative", False).otherwise(F.col("authoritative"))
    return j.withColumn("state", st).withColumn("authoritative", au).drop("_s", "_f")


def review_queue(log: DataFrame, scores: DataFrame) -> DataFrame:
    """Reviews whose last action is ``ingested``, lowest overall first."""
    open_ = latest_action(log).where("action = 'ingested'").select("review_id", "document_id", "ts")
    return open_.join(scores, "document_id").orderBy("overall", "review_id")


def timeline(log: DataFrame, year: int, source: str | None = None, mode: str | None = None) -> DataFrame:
    """Twelve months with the count of each action."""
    rows = log.where(F.year("at") == year)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if mode is not None:
        rows = rows.where(F.col("mode") == mode)
    c = rows.groupBy(F.month("at").alias("month")).agg(*[F.count_if(F.col("action") == a).alias(a) for a in STACKED])
    months = log.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(c, "month", "left").fillna(0)


def feedback_rate(feedback: DataFrame, answers: DataFrame) -> DataFrame:
    """Flagged answers over answers, per level."""
    f = feedback.groupBy("level").agg(F.count(F.lit(1)).alias("flagged"))
    a = answers.groupBy("level").agg(F.count(F.lit(1)).alias("answered"))
    j = a.join(f, "level", "left")
    return j.select("level", "answered", F.coalesce("flagged", F.lit(0)).alias("flagged"), F.round(F.coalesce("flagged", F.lit(0)) / F.col("answered"), 4).alias("rate"))


def trim_feedback(feedback: DataFrame) -> DataFrame:
    """Citations and prior turns of flagged answers cut to a safe size."""
    cites = F.transform(F.slice("citations", 1, 8), lambda c: F.struct(F.substring(c["title"], 1, 200).alias("title"), F.substring(c["snippet"], 1, 400).alias("snippet")))
    turns = F.transform(F.slice("context", 1, 3), lambda t: F.struct(F.substring(t["q"], 1, 400).alias("q"), F.substring(t["a"], 1, 800).alias("a")))
    return feedback.withColumn("citations", cites).withColumn("context", turns).withColumn("answer", F.substring("answer", 1, 2000))
