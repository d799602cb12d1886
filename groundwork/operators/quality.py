"""Corpus quality: citation usage, readability, per-document signals, scores, suggestions, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens

# Thresholds of the rules, sentence and word patterns.
DUPLICATE_SHARE, STALE_DAYS, READABILITY_REVIEW = 0.50, 365, 0.35
WORD, SENTENCE_END = r"[A-Za-z0-9_']+", r"[.!?]+(?:\s+|$)|\n+"


def citation_usage(passage_cites: DataFrame, title_cites: DataFrame, passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Traces that used each document: (document_id, uses), once per trace.

    ``passage_cites``: (trace_id, passage_id); ``title_cites``: (trace_id, title), both of answers
    with citations. A title owned by several documents counts for those the trace's passages belong
    to, else for all of them. That last case is added as one count per title: such a trace cannot
    also reach one of those documents by a passage, so no trace x document rows are needed for it.
    """
    owner = passages.select("passage_id", "document_id")
    via = passage_cites.join(owner, "passage_id").select("trace_id", "document_id").distinct()
    n = documents.groupBy("title").agg(F.count(F.lit(1)).alias("owners"), F.min("document_id").alias("only"))
    t = title_cites.select("trace_id", "title").distinct().join(n, "title")
    single = t.where("owners = 1").select("trace_id", F.col("only").alias("document_id"))
    direct = via.unionByName(single).distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("u"))
    narrowed = via.join(documents.select("document_id", "title"), "document_id").select("trace_id", "title").distinct()
    wide = t.where("owners > 1").join(narrowed, ["trace_id", "title"], "left_anti").groupBy("title").agg(F.count(F.lit(1)).alias("u"))
    spread = documents.select("document_id", "title").join(wide, "title").select("document_id", "u")
    return direct.unionByName(spread).groupBy("document_id").agg(F.sum("u").alias("uses"))


def readability(text: Column) -> Column:
    """1 - 0.6 x long-sentence penalty - 0.4 x long-word penalty, clamped; 0 without words."""
    w = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(w)
    sents = F.greatest(F.lit(1), F.size(F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(WORD))))
    length_pen = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n / sents - 15.0) / 30.0))
    long_pen = F.least(F.lit(1.0), F.size(F.filter(w, lambda x: F.length(x) >= 8)) / n / 0.6)
    s = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - 0.6 * length_pen - 0.4 * long_pen)), 4)
    return F.when(F.coalesce(n, F.lit(0)) > 0, s).otherwise(0.0)


def salient_tokens(text: Column) -> Column:
    """Distinct tokens longer than two letters outside the stop list."""
    stop = F.array(*[F.lit(w) for w in [*STOP_WORDS, "according"]])
    return F.filter(F.array_except(F.array_distinct(tokens(text)), stop), lambda t: F.length(t) > 2)


def orphan_ratio(passages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Share of a document's passages without a node: 1.0 without any node, 0.5 when no node is located.

    ``mentions``: (document_id, passage_id or null).
    """
    n = passages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    m = mentions.groupBy("document_id").agg(F.count_distinct("passage_id").alias("located"))
    j = n.join(m, "document_id", "left")
    r = F.when(F.col("located").isNull(), 1.0).when(F.col("located") == 0, 0.5).otherwise(F.round(1.0 - F.col("located") / F.col("n"), 4))
    return j.select("document_id", r.alias("orphan_ratio"))


def contradictions_by_hash(edges: DataFrame) -> DataFrame:
    """Flagged edges per content hash of their provenance array."""
    f = edges.where("conflict").select(F.explode("provenance").alias("content_hash"))
    return f.where("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("flags"))


def gap_hits(gaps: DataFrame, documents: DataFrame) -> DataFrame:
    """Open gap questions sharing a title token or three body tokens with a document.

    ``gaps``: (gap_id, text); ``documents``: (document_id, title, text). Body tokens outside the
    gap vocabulary leave first; shared tokens are counted per (document, gap) before the shuffle.
    """
    g = gaps.select("gap_id", F.explode(salient_tokens(F.col("text"))).alias("token"))
    vocab = g.select("token").distinct()
    tt = documents.select("document_id", F.explode(salient_tokens(F.coalesce("title", F.lit("")))).alias("token"))
    by_title = tt.join(g, "token").select("document_id", "gap_id").distinct()
    bt = documents.select("document_id", F.explode(salient_tokens(F.col("text"))).alias("token")).join(vocab, "token", "left_semi")
    body = bt.join(g, "token").groupBy("document_id", "gap_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    hits = by_title.unionByName(body.select("document_id", "gap_id")).distinct()
    return hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("gap_hits"))


def coverage(documents: DataFrame, vocab: list[str]) -> Column:
    """Share of the pack's vocabulary among the salient tokens of ``text``."""
    words = F.array(*[F.lit(w) for w in vocab])
    return F.round(F.size(F.array_intersect(salient_tokens(F.col("text")), words)) / F.lit(max(1, len(vocab))), 4)


def quality_score(df: DataFrame, places: int = 4) -> DataFrame:
    """Adds ``score`` from the signal columns (citation_uses, age_days, duplicate_passages, passages,
    contradiction_flags, readability, coverage, orphan_ratio, authoritative)."""
    share = F.when(F.col("passages") > 0, F.col("duplicate_passages") / F.col("passages")).otherwise(1.0)
    s = (
        0.25 * F.least(F.lit(1.0), F.col("citation_uses") / 3.0) + 0.15 * (1.0 - F.least(F.lit(1.0), F.col("age_days") / STALE_DAYS))
        + 0.20 * (1.0 - share) + 0.10 * (F.col("contradiction_flags") == 0).cast("double") + 0.10 * F.col("readability")
        + 0.10 * F.col("coverage") + 0.10 * (1.0 - F.col("orphan_ratio")) + F.when(F.col("authoritative"), 0.10).otherwise(0.0)
    )
    return df.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), places))


def suggest(df: DataFrame) -> DataFrame:
    """Adds ``suggestion`` (keep, review, delete) and the reason codes that led to it."""
    share = F.when(F.col("passages") > 0, F.col("duplicate_passages") / F.col("passages")).otherwise(0.0)
    dup = (F.col("passages") > 0) & (share >= DUPLICATE_SHARE)
    stale = (F.col("age_days") > STALE_DAYS) & (F.col("citation_uses") == 0)
    uncited, hard, conflict = F.col("citation_uses") == 0, F.col("readability") < READABILITY_REVIEW, F.col("contradiction_flags") > 0
    kill = dup | stale
    reasons = F.array_compact(F.array(
        F.when(dup, "duplicate"), F.when(stale, "stale and unused"), F.when(uncited, "never cited"), F.when(hard, "low readability"),
        F.when(conflict, "contradictions"), F.when((F.col("duplicate_passages") > 0) & ~kill, "some duplicate passages"),
        F.when(F.col("duplicated_by") > 0, "original of newer copies"), F.when(F.col("gap_hits") > 0, "near unanswered questions"),
        F.when(kill & F.col("authoritative"), "authoritative"),
    ))
    s = F.when(kill & F.col("authoritative"), "review").when(kill, "delete").when(uncited | hard | conflict, "review").otherwise("keep")
    out = df.withColumn("suggestion", s).withColumn("reasons", reasons)
    return out.withColumn("reasons", F.when((F.col("suggestion") == "keep") & (F.size("reasons") == 0), F.array(F.lit("cited, readable, unique and consistent"))).otherwise(F.col("reasons")))


def worst_first(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("suggestion") == "delete", 0).when(F.col("suggestion") == "review", 1).otherwise(2)
    return df.orderBy(rank, "score", "document_id")


def quality_rollup(quality: DataFrame) -> DataFrame:
    """Corpus totals, rates, suggestion counts and the risks they raise, in one row."""
    n = F.count(F.lit(1))
    g = quality.agg(
        n.alias("documents"), F.sum("passages").alias("passages"), F.sum("duplicate_passages").alias("_dup"), F.count_if(F.col("citation_uses") > 0).alias("_cited"),
        F.round(F.sum("readability") / n, 4).alias("readability_avg"),
        *[F.count_if(F.col("suggestion") == s).alias(f"n_{s}") for s in ("keep", "review", "delete")],
    )
    g = g.withColumn("duplicate_rate", F.when(F.col("passages") > 0, F.round(F.col("_dup") / F.col("passages"), 4)).otherwise(0.0))
    g = g.withColumn("citation_coverage", F.when(F.col("documents") > 0, F.round(F.col("_cited") / F.col("documents"), 4)).otherwise(0.0))
    risks = F.array_compact(F.array(
        F.when(F.col("duplicate_rate") >= 0.25, "duplicate content:high").when(F.col("duplicate_rate") > 0, "duplicate content:medium"),
        F.when(F.col("n_delete") > 0, "documents suggested for deletion:medium"), F.when(F.col("citation_coverage") < 0.5, "most documents never cited:medium"),
        F.when(F.col("readability_avg") < READABILITY_REVIEW, "low readability:low"),
    ))
    return g.withColumn("risks", F.array_join(risks, "; ")).drop("_dup", "_cited")


def health_snapshot(passages: DataFrame, nodes: DataFrame, edges: DataFrame, gaps: DataFrame, vocab: DataFrame) -> DataFrame:
    """One snapshot row: vocabulary coverage, connectedness, contradictions, gaps, counts.

    Coverage looks at whitespace words of the live passages; the passage side is a semi join that
    keeps at most one row per vocabulary term and task.
    """
    words = passages.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("term"))
    covered = words.join(vocab.select("term"), "term", "left_semi").distinct().agg(F.count(F.lit(1)).alias("covered"))
    v = vocab.agg(F.count(F.lit(1)).alias("terms"))
    p = passages.agg(F.count(F.lit(1)).alias("passages"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if("conflict").alias("contradictions"))
    g = gaps.agg(F.count(F.lit(1)).alias("gaps"))
    j = covered.join(v, F.lit(True)).join(p, F.lit(True)).join(n, F.lit(True)).join(e, F.lit(True)).join(g, F.lit(True))
    conn = F.when(F.col("nodes") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("edges") / F.greatest(F.lit(1), F.col("nodes"))))
    return j.select(
        F.round(F.col("covered") / F.greatest(F.lit(1), F.col("terms")), 6).alias("coverage"), F.round(conn, 6).alias("connectedness"),
        F.when(F.col("passages") > 0, 1.0).otherwise(0.0).alias("traceability"), "contradictions", "gaps", "passages", "nodes", "edges",
    )


def risk_register(snapshot: DataFrame) -> DataFrame:
    """Risks of the latest snapshot: (risk, value, severity)."""
    risks = F.array_compact(F.array(
        F.when(F.col("coverage") < 0.5, F.struct(F.lit("thin coverage").alias("risk"), F.round("coverage", 2).alias("value"), F.lit("high").alias("severity"))),
        F.when(F.col("contradictions") > 0, F.struct(F.lit("contradictions flagged").alias("risk"), F.col("contradictions").cast("double").alias("value"), F.lit("high").alias("severity"))),
        F.when(F.col("connectedness") < 0.3, F.struct(F.lit("sparse graph / orphan nodes").alias("risk"), F.round("connectedness", 2).alias("value"), F.lit("medium").alias("severity"))),
        F.when(F.col("gaps") > 0, F.struct(F.lit("unanswered demand (gap backlog)").alias("risk"), F.col("gaps").cast("double").alias("value"), F.lit("medium").alias("severity"))),
    ))
    return snapshot.select(F.explode(risks).alias("r")).select("r.*")
