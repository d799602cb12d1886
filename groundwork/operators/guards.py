"""Tenant, access and liveness predicates. They run below every scoring join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant_guard(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; an empty tenant is an error before any plan exists."""
    if not tenant:
        raise ValueError("tenant is required")
    return df.where(F.col("tenant") == tenant)


def accessible_acls(scopes: Column) -> Column:
    """Scopes plus ``public``, sorted."""
    return F.array_sort(F.array_union(F.coalesce(scopes, F.array().cast("array<string>")), F.array(F.lit("public"))))


def acl_visible(acl: Column | str, accessible: Column | Iterable[str]) -> Column:
    if not isinstance(accessible, Column):
        accessible = F.array(*[F.lit(a) for a in accessible])
    return F.arrays_overlap(acl, accessible)


def live(df: DataFrame, index_version: str | None = None) -> DataFrame:
    """Passages that no newer version superseded."""
    out = df.where(F.col("superseded_by").isNull())
    return out if index_version is None else out.where(F.col("index_version") == index_version)


def hold_out_review(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Drop passages of documents a curator still has in review."""
    held = documents.where(F.col("state") == "review").select("document_id")
    return passages.join(held, "document_id", "left_anti")


# What each role may do.
ROLE_ACTIONS = {
    "asker": ("ask",),
    "curator": ("ask", "curate", "promote", "reingest"),
    "admin": ("ask", "curate", "promote", "reingest", "admin", "set_budget", "config"),
    "agent": ("ask",),
}


def policy_check(requests: DataFrame, role_actions: DataFrame, budgets: DataFrame) -> DataFrame:
    """Decide each (request_id, tenant, roles, action) row.

    A request is allowed when any of its roles may do the action; ``ask`` is refused once the
    tenant has no budget left. A tenant without a budget row is unlimited.
    """
    ask = requests.select("request_id", "tenant", "action", F.explode_outer("roles").alias("role"))
    ok = ask.join(role_actions.withColumn("_ok", F.lit(True)), ["role", "action"], "left")
    ok = ok.groupBy("request_id", "tenant", "action").agg(F.bool_or(F.coalesce("_ok", F.lit(False))).alias("role_ok"))
    ok = ok.join(budgets.select("tenant", "remaining"), "tenant", "left")
    broke = (F.col("action") == "ask") & (F.coalesce("remaining", F.lit(1.0)) <= 0)
    return ok.select(
        "request_id",
        (F.col("role_ok") & ~broke).alias("allowed"),
        F.when(~F.col("role_ok"), "role").when(broke, "budget").otherwise("ok").alias("reason"),
    )


def bank_gate(bank: DataFrame, doc_acl: DataFrame, accessible: Iterable[str]) -> DataFrame:
    """Banked questions whose every expected document is visible.

    ``bank`` has (question_id, expected array); ``doc_acl`` has (document_id, acl).
    A question naming an unknown document is hidden.
    """
    want = bank.select("question_id", F.explode("expected").alias("document_id"))
    seen = want.join(doc_acl, "document_id", "left")
    vis = F.coalesce(acl_visible(F.col("acl"), accessible), F.lit(False))
    return seen.groupBy("question_id").agg(F.bool_and(vis).alias("_v")).where("_v").select("question_id")
