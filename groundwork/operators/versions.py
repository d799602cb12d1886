"""Ingest state: change detection, versions, rollback, tombstones, schedules and runs.

Tables: ``documents`` (tenant, document_id, source, uri, content_hash, current_version, status),
``passages`` (passage_id, document_id, version, pos, text, superseded_by) and the version ledger in
two parts, one summary row per (document, version) and one row per (document, version, passage),
so that no list of a document's passages is ever gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import latest


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def stable_id(*parts: Column) -> Column:
    """Deterministic id in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 24)


def ingest_diff(incoming: DataFrame, documents: DataFrame, order: Sequence[str] = ("content_hash",)) -> DataFrame:
    """Status of each incoming record by (tenant, source, uri): noop, updated or ok (new), with its version.

    ``incoming`` has content_hash. The document table is only joined on its key columns. Several
    records of one key are taken one after the other, by ``order``: each is compared with the one
    before it, and each change has a version of its own.
    """
    keys = ["tenant", "source", "uri"]
    known = documents.where("status = 'active'").select(
        *keys, F.col("document_id").alias("_id"), F.col("content_hash").alias("_h"), F.col("current_version").alias("_v")
    )
    j = incoming.join(known, keys, "left")
    w = Window.partitionBy(*keys).orderBy(*order)
    j = j.withColumn("_new", ~F.coalesce(F.lag("content_hash").over(w), F.col("_h")).eqNullSafe(F.col("content_hash")))
    changes = F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("version", (F.coalesce("_v", F.lit(0)) + changes).cast(dict(j.dtypes)["_v"]))
    status = F.when(~F.col("_new"), "noop").when(F.col("_id").isNull() & (F.col("version") == 1), "ok").otherwise("updated")
    return (
        j.withColumn("status", status)
        .withColumn("document_id", F.coalesce("_id", stable_id(*[F.col(k) for k in keys])))
        .drop("_id", "_h", "_v", "_new")
    )


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: the incoming row wins. One anti join, the stored rows stay as they are."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def supersede(passages: DataFrame, changed: DataFrame) -> DataFrame:
    """Live passages of a changed document get ``superseded_by = v<version>``.

    ``changed``: (document_id, version).
    """
    c = changed.select("document_id", F.concat(F.lit("v"), F.col("version").cast("string")).alias("_new"))
    j = passages.join(c, "document_id", "left")
    return j.withColumn("superseded_by", F.coalesce("superseded_by", "_new")).drop("_new")


def tombstone(documents: DataFrame, passages: DataFrame, vectors: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deleted (tenant, source, uri): mark the documents, drop their passages and vectors. Other tenants' stay."""
    keys = ["tenant", "source", "uri"]
    gone = documents.join(deleted.select(*keys).distinct().withColumn("_x", F.lit(True)), keys, "left")
    docs = gone.withColumn("status", F.when(F.col("_x"), "tombstoned").otherwise(F.col("status"))).drop("_x")
    dead = docs.where("status = 'tombstoned'").select("document_id")
    left = passages.join(dead, "document_id", "left_anti")
    dead_p = passages.join(dead, "document_id", "left_semi").select("passage_id")
    return docs, left, vectors.join(dead_p, "passage_id", "left_anti")


def bulk_tombstone(documents: DataFrame, passages: DataFrame, vectors: DataFrame, match: Column, subject: str, at: Column) -> dict[str, DataFrame]:
    """Tombstone every active document matching a predicate, with one audit row each."""
    hit = documents.where(match & (F.col("status") == "active"))
    d, p, v = tombstone(documents, passages, vectors, hit.select("tenant", "source", "uri"))
    audit = hit.select(
        F.lit(subject).alias("subject"), F.lit("document.delete").alias("action"),
        F.concat(F.lit("document:"), F.col("document_id").cast("string")).alias("resource"), F.lit("allow").alias("decision"), at.alias("at"),
    )
    return {"documents": d, "passages": p, "vectors": v, "audit": audit}


def changed_only(documents: DataFrame, state: DataFrame) -> DataFrame:
    """Work list: documents whose (id, hash) is not in the last state."""
    return documents.join(state.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def missing_vectors(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live passages without a stored vector, to be embedded again."""
    return passages.where("superseded_by IS NULL").join(vectors.select("passage_id"), "passage_id", "left_anti")


def record_versions(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows: summaries per (document, version) and the passages of each version."""
    rows = passages.select("document_id", "version", "pos", "passage_id").distinct()
    summary = passages.groupBy("document_id", "version").agg(
        F.count(F.lit(1)).alias("passages"), F.min("content_hash").alias("content_hash"),
        F.min("source_version").alias("source_version"),
    )
    return summary, rows


def backfill(ledger: DataFrame, passages: DataFrame) -> DataFrame:
    """Ledger summaries for versions that only exist in the passage table."""
    summary, _ = record_versions(passages)
    return summary.join(ledger.select("document_id", "version"), ["document_id", "version"], "left_anti")


def history(ledger: DataFrame, passages: DataFrame) -> DataFrame:
    """All versions, ledger rows first, passage-only versions merged in."""
    seen, _ = record_versions(passages)
    s = seen.select("document_id", "version", F.col("passages").alias("_p"), F.col("content_hash").alias("_h"))
    j = ledger.join(s, ["document_id", "version"], "full")
    return j.select(
        "document_id", "version", F.coalesce("content_hash", "_h").alias("content_hash"),
        F.coalesce("passages", "_p").alias("passages"), F.col("content_hash").isNotNull().alias("recorded"),
    )


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference of passage texts per document: added, removed, unchanged counts.

    Works on counts per (document, text hash), so a line repeated a million times is one row.
    """
    key = F.sha2("text", 256).alias("_t")
    a = before.groupBy("document_id", key).agg(F.count(F.lit(1)).alias("a"))
    b = after.groupBy("document_id", key).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, ["document_id", "_t"], "full").fillna(0, ["a", "b"])
    return j.groupBy("document_id").agg(
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"),
        F.sum(F.least("a", "b")).alias("unchanged"),
    )


def diff_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The removed and added passages themselves, in document order (first surplus copies)."""
    out = []
    for mine, other, kind in ((before, after, "removed"), (after, before, "added")):
        w = Window.partitionBy("document_id", "_t").orderBy("pos")
        m = mine.withColumn("_t", F.sha2("text", 256)).withColumn("_n", F.row_number().over(w))
        tot = m.groupBy("document_id", "_t").agg(F.count(F.lit(1)).alias("_mine"))
        o = other.groupBy("document_id", F.sha2("text", 256).alias("_t")).agg(F.count(F.lit(1)).alias("_o"))
        sur = tot.join(o, ["document_id", "_t"], "left").select("document_id", "_t", (F.col("_mine") - F.coalesce("_o", F.lit(0))).alias("_s"))
        out.append(m.join(sur, ["document_id", "_t"]).where("_n <= _s").select("document_id", F.lit(kind).alias("change"), "pos", "text"))
    return out[0].unionByName(out[1])


def rollback(documents: DataFrame, passages: DataFrame, ledger: DataFrame, ledger_rows: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Restore ``to_version`` of the requested documents as a new version.

    ``requests``: (document_id, to_version). A request whose passages are not all present is
    refused and changes nothing. Returns outcome, documents, passages and the new ledger rows.
    """
    target = ledger_rows.join(requests, "document_id").where("version = to_version").select("document_id", "to_version", "pos", "passage_id")
    have = target.join(passages.select("passage_id", F.lit(1).alias("_in")), "passage_id", "left")
    full = have.groupBy("document_id", "to_version").agg(F.count(F.lit(1)).alias("need"), F.sum("_in").alias("present"))
    top = ledger.groupBy("document_id").agg(F.max("version").alias("_lv"))
    live_n = passages.where("superseded_by IS NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("_live"))
    plan = requests.join(full, ["document_id", "to_version"], "left").join(top, "document_id", "left")
    plan = plan.join(documents.select("document_id", "current_version"), "document_id", "left").join(live_n, "document_id", "left")
    ok = F.coalesce(F.col("need") == F.col("present"), F.lit(False)) & F.col("current_version").isNotNull()
    plan = plan.select(
        "document_id", "to_version", ok.alias("ok"),
        F.when(ok, F.greatest(F.coalesce("current_version", F.lit(1)), "_lv") + 1).alias("new_version"),
        F.when(ok, F.col("need")).alias("reactivated"), F.when(ok, F.coalesce("_live", F.lit(0))).alias("superseded"),
    )
    good = plan.where("ok")
    back = target.join(good.select("document_id", "new_version"), "document_id")
    mark = passages.join(good.select("document_id", "new_version"), "document_id", "left")
    mark = mark.join(back.select("passage_id", F.lit(True).alias("_back")), "passage_id", "left")
    now = F.when(F.col("_back"), F.lit(None).cast("string")).otherwise(
        F.coalesce("superseded_by", F.concat(F.lit("v"), F.col("new_version").cast("string")))
    )
    restored = ledger.join(good.select("document_id", F.col("to_version").alias("version"), "new_version"), ["document_id", "version"])
    docs = documents.join(restored.select("document_id", "new_version", F.col("content_hash").alias("_h")), "document_id", "left")
    docs = docs.withColumn("current_version", F.coalesce("new_version", "current_version")).withColumn("content_hash", F.coalesce("_h", "content_hash"))
    return {
        "outcome": plan,
        "documents": docs.drop("new_version", "_h"),
        "passages": mark.withColumn("superseded_by", now).drop("new_version", "_back"),
        "ledger": restored.drop("version").withColumnRenamed("new_version", "version"),
        "ledger_rows": back.select("document_id", F.col("new_version").alias("version"), "pos", "passage_id"),
    }


def bump_dataset(history_: DataFrame, changes: DataFrame, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Next dataset version per tenant with a change, with its document and passage counts.

    ``changes``: (tenant, reason); a batch with any change bumps its tenant once.
    """
    why = changes.groupBy("tenant").agg(F.min("reason").alias("reason"))
    top = history_.groupBy("tenant").agg(F.max("version").alias("_v"))
    d = documents.where("status = 'active'").groupBy("tenant").agg(F.count(F.lit(1)).alias("documents"))
    p = passages.where("superseded_by IS NULL").groupBy("tenant").agg(F.count(F.lit(1)).alias("passages"))
    j = why.join(top, "tenant", "left").join(d, "tenant", "left").join(p, "tenant", "left")
    return j.select(
        "tenant", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "reason",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("passages", F.lit(0)).alias("passages"),
    )


def list_dataset_versions(history_: DataFrame, tenant: str, limit: int | None = None) -> DataFrame:
    """A tenant's dataset versions, newest first; the first ``limit`` if one is asked for."""
    out = history_.where(F.col("tenant") == tenant).orderBy(F.desc("version"))
    return out if limit is None else out.limit(limit)


def lineage(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passage to document, hash, version, live flag and coordinate."""
    d = documents.select("document_id", "uri", "source", F.col("content_hash").alias("document_hash"), "current_version")
    j = passages.join(d, "document_id", "left")
    return j.withColumn("live", F.col("superseded_by").isNull())


def source_health(cursors: DataFrame, now_ms: int) -> DataFrame:
    """Minutes since the last sync per source."""
    age = (F.lit(now_ms) - F.coalesce("last_sync", F.lit(now_ms))) / 60000
    return cursors.select("source", "items", F.round(age, 1).alias("freshness_minutes"), "last_sync")


def due(schedules: DataFrame, now_s: float) -> DataFrame:
    return schedules.where(F.col("enabled") & (F.col("next_run") <= now_s)).orderBy("next_run", "source")


# Refresh objective factor and back-off ceiling.
SLA_FACTOR, MAX_BACKOFF = 2, 4


def refresh_health(schedules: DataFrame, cursors: DataFrame, now_s: float) -> DataFrame:
    """Freshness and objective breach per source that is scheduled or was ever synced.

    Schedules: (source, enabled, connector_enabled, interval_s, last_run, error_count);
    cursors: (source, last_sync in ms, items).
    """
    j = schedules.join(cursors, "source", "full")
    last = F.greatest(F.col("last_run").cast("double"), F.col("last_sync") / 1000.0)
    fresh = F.round(F.greatest(F.lit(0.0), F.lit(now_s) - last) / 60.0, 1)
    enabled = F.coalesce(F.col("enabled") & F.col("connector_enabled"), F.lit(False))
    errors = F.coalesce("error_count", F.lit(0))
    breach = F.when(
        enabled & (F.col("interval_s") > 0),
        F.when(fresh.isNotNull(), fresh > SLA_FACTOR * F.col("interval_s") / 60.0).otherwise(errors > 0),
    ).otherwise(False)
    return j.select(
        "source", enabled.alias("enabled"), fresh.alias("freshness_minutes"), errors.alias("error_count"),
        F.coalesce("items", F.lit(0)).alias("items"), breach.alias("sla_breach"),
    )


def back_off(now_s: Column, interval_s: Column, errors: Column) -> Column:
    """Next run after ``errors`` failures in a row."""
    return now_s + interval_s * F.least(F.lit(MAX_BACKOFF), 1 + errors)


def step_rollup(steps: DataFrame) -> DataFrame:
    """Fold run steps per (run, name): sums, worst status, last time."""
    sev = F.when(F.col("status") == "error", 2).when(F.col("status") == "skipped", 0).otherwise(1)
    out = steps.groupBy("run_id", "name").agg(
        F.sum("count").alias("count"), F.round(F.sum("ms"), 2).alias("ms"), F.count(F.lit(1)).alias("entries"),
        F.max("at").alias("last_at"), F.max(sev).alias("_s"),
    )
    return out.withColumn("status", F.element_at(F.array(F.lit("skipped"), F.lit("ok"), F.lit("error")), F.col("_s") + 1)).drop("_s")


def run_listing(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first with duration; a run without an end is active."""
    out = runs.withColumn("active", F.col("ended_at").isNull()).withColumn(
        "duration_s", F.round(F.col("ended_at") - F.col("started_at"), 2)
    )
    return out if limit is None else out.orderBy(F.desc("started_at"), "run_id").limit(limit)


def sync(records: DataFrame, cursor: DataFrame, allow: DataFrame) -> dict[str, DataFrame]:
    """Delta pull of change records against a cursor table.

    ``records``: (tenant, source, scope, uri, updated, deleted, ...); ``cursor``: (tenant, source, cursor,
    items); ``allow``: (tenant, source, scope). Only allowed scopes newer than the cursor pass; the last change of a
    uri wins; deletions split off; the cursor advances to the newest change and counts items.
    """
    r = records.join(allow, ["tenant", "source", "scope"], "left_semi").join(cursor.select("tenant", "source", "cursor"), ["tenant", "source"], "left")
    r = r.where(F.col("cursor").isNull() | (F.col("updated") > F.col("cursor"))).drop("cursor")
    last = latest(r, ["tenant", "source", "uri"], ["updated", "change_id"])
    pulled = last.where("not deleted")
    dead = last.where("deleted").select("tenant", "source", "uri", "updated")
    moved = last.groupBy("tenant", "source").agg(
        F.max("updated").alias("_c"), F.count_if(~F.col("deleted")).alias("pulled"), F.count_if("deleted").alias("tombstoned")
    )
    j = cursor.join(moved, ["tenant", "source"], "full")
    new = j.select(
        "tenant", "source", F.greatest("cursor", "_c").alias("cursor"),
        (F.coalesce("items", F.lit(0)) + F.coalesce("pulled", F.lit(0))).alias("items"),
        F.coalesce("pulled", F.lit(0)).alias("pulled"), F.coalesce("tombstoned", F.lit(0)).alias("tombstoned"),
    )
    return {"pulled": pulled, "tombstones": dead, "cursor": new}
