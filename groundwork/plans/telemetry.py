"""Telemetry queries: events as answer spans, order lines as ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry as M
from ..registry import query
from ..session import table

NOW = 1706659200  # 2024-01-31

_EV = """
s AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS started_at, user_id::VARCHAR AS subject, event_type, value AS duration_ms,
  json_extract_string(props, '$.k')::BIGINT AS k,
  CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'fast' WHEN 'purchase' THEN 'reason' WHEN 'signup' THEN 'clarify' ELSE 'gap' END AS level,
  CASE event_type WHEN 'click' THEN 'fast' WHEN 'purchase' THEN 'deep' ELSE 'none' END AS tier,
  CASE WHEN json_extract_string(props, '$.k')::BIGINT < 50 THEN 'asker' ELSE 'curator,asker' END AS roles FROM events),
a AS (SELECT *, k * 20 AS tokens_in, k * 20 AS tokens_out, k * 40 AS tokens,
  CASE WHEN tier = 'none' THEN k * 40 * 5e-2 / 1e6 ELSE (k * 20 * 3e0 + k * 20 * 15e0) / 1e6 END AS cost, k < 10 AS cache_hit,
  CASE WHEN k < 5 THEN 'answer' WHEN k < 10 THEN 'retrieval' END AS technique, least(1e0, k / 1e2) AS grounding, k // 25 AS citations_count,
  CASE WHEN k < 80 THEN 'en' ELSE 'fr' END AS lang, CASE WHEN k < 30 THEN 'general' WHEN k < 60 THEN 'developer' ELSE 'executive' END AS persona,
  CASE event_type WHEN 'view' THEN 'jira' WHEN 'click' THEN 'document' ELSE 'code' END AS source_kind FROM s)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """One answer span per event."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    level = F.when(F.col("event_type") == "view", "lookup").when(F.col("event_type") == "click", "fast").when(
        F.col("event_type") == "purchase", "reason").when(F.col("event_type") == "signup", "clarify").otherwise("gap")
    tier = F.when(F.col("event_type") == "click", "fast").when(F.col("event_type") == "purchase", "deep").otherwise("none")
    kind = F.when(F.col("event_type") == "view", "jira").when(F.col("event_type") == "click", "document").otherwise("code")
    s = e.select(
        F.lit("t1").alias("tenant"), F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("trace_id"), F.lit("answer").alias("name"),
        F.lit("answer").alias("stage"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("started_at"), F.col("user_id").cast("string").alias("subject"),
        "event_type", F.col("value").alias("duration_ms"), k.alias("k"), level.alias("level"), tier.alias("tier"),
        F.when(k < 50, "asker").otherwise("curator,asker").alias("roles"),
        F.to_json(F.struct(
            F.when(k < 30, "").when(k < 60, "developer").otherwise("executive").alias("persona"), kind.alias("source_kind"), (k > 70).alias("context_resolved"),
        )).alias("attrs"),
        F.to_json(F.struct(
            level.alias("level_name"), F.array_compact(F.array(
                F.struct(F.col("event_type").alias("code")), F.when(k > 50, F.struct(F.lit("long_query").alias("code"))),
            )).alias("reasons"),
        )).alias("why"),
    )
    s = s.withColumn("tokens_in", F.col("k") * 20).withColumn("tokens_out", F.col("k") * 20).withColumn("tokens", F.col("k") * 40)
    cost = F.when(F.col("tier") == "none", F.col("k") * 40 * 5e-2 / 1e6).otherwise((F.col("k") * 20 * 3.0 + F.col("k") * 20 * 15.0) / 1e6)
    s = s.withColumn("cost", cost).withColumn("cache_hit", F.col("k") < 10)
    return (
        s.withColumn("cache_technique", F.when(F.col("k") < 5, "answer").when(F.col("k") < 10, "retrieval"))
        .withColumn("cost_saved", F.when(F.col("k") < 10, F.col("cost") / 2).otherwise(0.0))
        .withColumn("grounding", F.least(F.lit(1.0), F.col("k") / 100.0)).withColumn("citations_count", F.expr("k div 25"))
        .withColumn("lang", F.when(F.col("k") < 80, "en").otherwise("fr"))
        .withColumn("complexity", F.when(F.col("k") > 66, "complex").when(F.col("k") > 33, "medium"))
        .withColumn("model_name", F.when(F.col("tier") == "fast", "small").when(F.col("tier") == "deep", "large"))
        .withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    )


@query("answer_metrics", "M1", f"""
WITH {_EV}, r AS (SELECT *, row_number() OVER (ORDER BY duration_ms) - 1 AS i, count(*) OVER () AS n FROM a)
SELECT 't1' AS tenant, count(*)::BIGINT AS answers, round(sum(cost), 6) AS total_cost, sum(tokens)::BIGINT AS total_tokens, round(sum(grounding) / count(*), 4) AS grounding_avg,
 round((count(*) FILTER (citations_count > 0)) / count(*)::DOUBLE, 4) AS citation_coverage, round((count(*) FILTER (level = 'clarify')) / count(*)::DOUBLE, 4) AS clarify_back_rate,
 max(duration_ms) FILTER (i = least(n - 1, floor(n * 5e-1))) AS latency_p50_ms, max(duration_ms) FILTER (i = least(n - 1, floor(n * 95e-2))) AS latency_p95_ms FROM r
""")
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.answer_metrics(spans(spark, sf))


@query("cost_by_tier_stage", "M1", f"""
WITH {_EV} SELECT 'tier' AS dimension, tier AS bucket, round(sum(cost), 6) AS cost FROM a GROUP BY tier UNION ALL SELECT 'stage', 'answer', round(sum(cost), 6) FROM a
""")
def cost_by_tier_stage(spark: SparkSession, sf: str) -> DataFrame:
    return M.cost_by(spans(spark, sf))


@query("analytics_rollup", "M2 P8", f"""
WITH {_EV}, w AS (SELECT * FROM a WHERE started_at >= {NOW} - 7 * 86400)
SELECT 'level' AS dimension, level AS bucket, count(*)::BIGINT AS n FROM w GROUP BY ALL
UNION ALL SELECT 'tier', tier, count(*)::BIGINT FROM w GROUP BY ALL
UNION ALL SELECT 'complexity', CASE WHEN k > 66 THEN 'complex' WHEN k > 33 THEN 'medium' ELSE 'n/a' END, count(*)::BIGINT FROM w GROUP BY ALL
UNION ALL SELECT 'model', CASE tier WHEN 'fast' THEN 'small' WHEN 'deep' THEN 'large' ELSE 'none (extractive)' END, count(*)::BIGINT FROM w GROUP BY ALL
UNION ALL SELECT 'reason', event_type, count(*)::BIGINT FROM w GROUP BY ALL
UNION ALL SELECT 'reason', 'long_query', count(*)::BIGINT FROM w WHERE k > 50
""")
def analytics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return M.routing(M.window_filter(spans(spark, sf), NOW, 7 * 86400))


@query("cache_savings", "M3", f"""
WITH {_EV} SELECT technique, count(*)::BIGINT AS hits, round(sum(cost / 2), 6) AS saved FROM a WHERE cache_hit GROUP BY 1
""")
def cache_savings(spark: SparkSession, sf: str) -> DataFrame:
    return M.savings(spans(spark, sf))


@query("user_rollup", "M4", f"""
WITH {_EV} SELECT subject, count(*)::BIGINT AS answers, round(sum(cost), 6) AS cost, sum(tokens)::BIGINT AS tokens FROM a WHERE roles LIKE '%curator%' GROUP BY 1
""")
def user_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return M.rollup_users(M.window_filter(spans(spark, sf), NOW, 1e12, role="curator"))


@query("role_rollup", "M4 P8", f"""
WITH {_EV} SELECT role, count(*)::BIGINT AS answers, round(sum(cost), 6) AS cost FROM (SELECT unnest(string_split(roles, ',')) AS role, cost FROM a) GROUP BY 1
""")
def role_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return M.rollup_roles(spans(spark, sf))


@query("time_series", "M5", f"""
WITH {_EV}, f AS (SELECT *, floor((started_at - ({NOW} - 30 * 86400)) / 86400)::BIGINT AS bucket FROM a WHERE started_at >= {NOW} - 30 * 86400)
SELECT bucket, count(*)::BIGINT AS answers, round(sum(cost), 6) AS cost, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
 round(sum(CASE WHEN cache_hit THEN cost / 2 ELSE 0e0 END), 6) AS cost_saved, round(sum(duration_ms) / count(*), 1) AS latency_ms,
 (count(*) FILTER (level = 'reason'))::BIGINT AS reason, (count(*) FILTER (level = 'gap'))::BIGINT AS gap FROM f GROUP BY 1
""")
def time_series(spark: SparkSession, sf: str) -> DataFrame:
    floor = NOW - 30 * 86400
    s = M.time_series(M.window_filter(spans(spark, sf), NOW, 30 * 86400), floor, 86400)
    lv = lambda x: F.coalesce(F.try_element_at("by_level", F.lit(x)), F.lit(0))
    return s.withColumn("reason", lv("reason")).withColumn("gap", lv("gap")).drop("by_level")


@query("language_persona", "M6", f"""
WITH {_EV} SELECT 'language' AS dimension, lang AS bucket, count(*)::BIGINT AS n, (count(*) FILTER (k > 70))::BIGINT AS context_resolved FROM a GROUP BY ALL
UNION ALL SELECT 'persona', persona, count(*)::BIGINT, (count(*) FILTER (k > 70))::BIGINT FROM a GROUP BY ALL
""")
def language_persona(spark: SparkSession, sf: str) -> DataFrame:
    return M.spread_counts(spans(spark, sf))


@query("flat_events", "M7", f"""
WITH {_EV} SELECT id::VARCHAR AS trace_id, subject, CASE WHEN k < 50 THEN 'asker' ELSE 'curator' END AS role, persona, CASE WHEN k > 70 THEN 'resolved' ELSE 'direct' END AS context,
 level, tier, source_kind, upper(lang) AS lang, CASE WHEN k > 66 THEN 'complex' WHEN k > 33 THEN 'medium' ELSE 'simple' END AS complexity,
 CASE WHEN level IN ('gap', 'clarify') THEN 'gap' ELSE 'answer' END AS kind, (citations_count > 0)::INTEGER AS cited, round(cost, 6) AS cost, duration_ms AS latency_ms FROM a
""")
def flat_events(spark: SparkSession, sf: str) -> DataFrame:
    return M.flat_events(spans(spark, sf)).select(
        "trace_id", "subject", "role", "persona", "context", "level", "tier", "source_kind", "lang", "complexity", "kind", "cited", "cost", "latency_ms"
    )


# A trace is one user's day; the span name comes from the event type.
_TRACE = """
t AS (SELECT user_id || ':' || (epoch_us(ts) // 86400000000) AS trace_id, event_id AS id, epoch_us(ts) / 1e6 AS started_at, value * 1e5 AS duration_ms, event_type,
  CASE event_type WHEN 'signup' THEN 'answer' WHEN 'view' THEN 'answer.retrieve' WHEN 'click' THEN 'answer.retrieve.bm25' WHEN 'purchase' THEN 'answer.compose' ELSE 'ingest.detect' END AS name FROM events)"""


def trace_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    name = F.when(F.col("event_type") == "signup", "answer").when(F.col("event_type") == "view", "answer.retrieve").when(
        F.col("event_type") == "click", "answer.retrieve.bm25").when(F.col("event_type") == "purchase", "answer.compose").otherwise("ingest.detect")
    return e.select(
        F.lit("t1").alias("tenant"), F.concat_ws(":", F.col("user_id").cast("string"), F.floor(us / 86400000000).cast("string")).alias("trace_id"),
        F.col("event_id").alias("id"), (us / 1e6).alias("started_at"), (F.col("value") * 1e5).alias("duration_ms"), name.alias("name"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
    )


@query("trace_spans", "M8", f"""
WITH {_TRACE} SELECT trace_id, id, name, started_at FROM t WHERE trace_id = (SELECT arg_min(trace_id, id) FROM t)
""")
def trace_spans(spark: SparkSession, sf: str) -> DataFrame:
    """All spans of the trace that the first span belongs to."""
    t = trace_table(spark, sf)
    return M.trace_spans(t, "t1", t.agg(F.min_by("trace_id", "id").alias("trace_id")).first()["trace_id"]).select("trace_id", "id", "name", "started_at")


@query("waterfall", "M9", f"""
WITH {_TRACE} SELECT trace_id, id, name, round((started_at - min(started_at) OVER w) * 1000, 2) AS offset_ms, round(duration_ms, 2) AS duration_ms,
 round((max(started_at + duration_ms / 1e3) OVER w - min(started_at) OVER w) * 1000, 2) AS total_ms FROM t WINDOW w AS (PARTITION BY trace_id)
""")
def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return M.waterfall(trace_table(spark, sf))


@query("span_parent", "J13", f"""
WITH {_TRACE}, pre AS (SELECT trace_id, id, started_at AS at, unnest(CASE name WHEN 'answer.retrieve.bm25' THEN ['answer.retrieve', 'answer'] WHEN 'answer' THEN []::VARCHAR[] WHEN 'ingest.detect' THEN ['ingest'] ELSE ['answer'] END) AS prefix FROM t),
nm AS (SELECT trace_id, name AS prefix, arg_min(id, (started_at, id)) AS first_id FROM t GROUP BY ALL),
lg AS (SELECT p.trace_id, p.id, p.at, p.prefix, n.first_id FROM pre p JOIN nm n USING (trace_id, prefix) QUALIFY row_number() OVER (PARTITION BY p.trace_id, p.id ORDER BY length(prefix) DESC) = 1),
ins AS (SELECT lg.trace_id, lg.id, arg_min(c.id, (c.started_at, c.id)) AS cid FROM lg JOIN t c ON c.trace_id = lg.trace_id AND c.name = lg.prefix
   AND c.started_at - 1e-3 <= lg.at AND lg.at <= c.started_at + c.duration_ms / 1e3 + 1e-3 GROUP BY ALL),
rt AS (SELECT trace_id, count(*) AS nr, min(id) AS root FROM t WHERE name NOT LIKE '%.%' GROUP BY 1)
SELECT t.trace_id, t.id, t.name, coalesce(ins.cid, lg.first_id, CASE WHEN t.name LIKE '%.%' AND rt.nr = 1 AND rt.root <> t.id THEN rt.root END) AS parent_id
FROM t LEFT JOIN lg USING (trace_id, id) LEFT JOIN ins USING (trace_id, id) LEFT JOIN rt USING (trace_id)
""")
def span_parent(spark: SparkSession, sf: str) -> DataFrame:
    return M.span_parents(trace_table(spark, sf))


@query("trace_export", "S24", f"""
WITH {_TRACE} SELECT 't1' AS tenant, substr(sha256(trace_id), 1, 32) AS "traceId", substr(sha256(trace_id || '|' || id), 1, 16) AS "spanId", name,
 (round(started_at * 1e9)::BIGINT)::VARCHAR AS "startTimeUnixNano", (round(started_at * 1e9)::BIGINT + round(duration_ms * 1e6)::BIGINT)::VARCHAR AS "endTimeUnixNano",
 (CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)::INTEGER AS "statusCode" FROM t
""")
def trace_export(spark: SparkSession, sf: str) -> DataFrame:
    return M.trace_export(trace_table(spark, sf)).drop("parentSpanId")


@query("service_levels", "M10 M11", f"""
WITH {_EV}, e AS (SELECT * FROM a WHERE level NOT IN ('gap', 'clarify')),
r AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY persona) AS c FROM e),
x AS (SELECT persona, count(*) AS x FROM a WHERE event_type = 'signup' GROUP BY 1)
SELECT persona, count(*)::BIGINT AS n, round((count(*) FILTER (tier <> 'deep')) / count(*)::DOUBLE, 3) AS fast_share, round((count(*) FILTER (tier = 'deep')) / count(*)::DOUBLE, 3) AS agent_share,
 round(sum(round(cost, 6)) / count(*), 6) AS cost_per_answer, max(duration_ms) FILTER (i = round_even(5e-1 * (c - 1), 0)) AS p50_ms, max(duration_ms) FILTER (i = round_even(95e-2 * (c - 1), 0)) AS p95_ms,
 round(coalesce(max(x.x), 0) / count(*)::DOUBLE, 3) AS explain_rate FROM r LEFT JOIN x USING (persona) GROUP BY persona
""")
def service_levels(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf)
    ev = M.flat_events(s)
    return M.service_levels(ev, "persona", M.flat_events(s.where("event_type = 'signup'")))


@query("explain_counts", "M11", f"""
WITH {_EV} SELECT persona, count(*)::BIGINT AS n FROM a WHERE event_type = 'signup' GROUP BY persona UNION ALL SELECT NULL, count(*)::BIGINT FROM a WHERE event_type = 'signup'
""")
def explain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.explain_counts(spans(spark, sf).where("event_type = 'signup'").withColumn("name", F.lit("explain.requested")))


@query("percentile_exact", "M21", """
WITH r AS (SELECT event_type AS phase, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT phase, max(c)::BIGINT AS n, max(value) FILTER (i = least(c - 1, floor(c * 5e-1))) AS p50, max(value) FILTER (i = least(c - 1, floor(c * 95e-2))) AS p95,
 max(value) FILTER (i = least(c - 1, floor(c * 99e-2))) AS p99 FROM r GROUP BY 1
""")
def percentile_exact(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("phase"), "value")
    return M.timing_percentiles(e, ["phase"], "value")


@query("active_idle", "M17", f"""
WITH {_EV}, x AS (SELECT id, least(k * 2e0 + k * 1e0, duration_ms) AS act, duration_ms FROM a), y AS (SELECT *, CASE WHEN duration_ms > 0 THEN act ELSE act END AS ac, greatest(0e0, duration_ms - act) AS idle FROM x)
SELECT id, round(ac, 2) AS active_ms, round(idle, 2) AS idle_ms, CASE WHEN ac + idle > 0 THEN round(1e2 * ac / (ac + idle), 2) ELSE 0e0 END AS active_pct FROM y
""")
def active_idle(spark: SparkSession, sf: str) -> DataFrame:
    e = spans(spark, sf).select("id", F.col("duration_ms").alias("total_ms"), F.create_map(F.lit("retrieve"), F.col("k") * 2.0, F.lit("compose"), F.col("k") * 1.0).alias("phase_ms"))
    return M.active_idle(e).select("id", "active_ms", "idle_ms", "active_pct")


# Ledger: one row per order line; prices cover two of the three models.
PRICES = [("model-A", 3.0, 15.0, 0.3, 3.75), ("model-N", 1.0, 5.0, 0.1, 1.25)]
_LED = """
c AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey AS run_id, ['answer_bake','repo_summary','agent_step','translate','image_describe','question_gen','other_tool'][l_linenumber] AS p,
  'model-' || l_returnflag AS model, 'repo' || l_suppkey AS repo, l_linestatus AS workflow, l_quantity::BIGINT * 100 AS input_tokens, l_quantity::BIGINT * 20 AS output_tokens,
  (l_partkey % 100) * 10 AS cache_read, round(l_discount * 100)::BIGINT * 4 AS cache_write, round(l_tax * 100)::BIGINT * 10 AS thinking FROM lineitem),
l AS (SELECT *, CASE WHEN p IN ('answer_bake','repo_summary','agent_step','translate','image_describe','question_gen') THEN p ELSE 'unknown:' || p END AS purpose,
  CASE model WHEN 'model-A' THEN round(input_tokens * 3e0 / 1e6 + output_tokens * 15e0 / 1e6 + cache_read * 3e-1 / 1e6 + cache_write * 375e-2 / 1e6, 8)
   WHEN 'model-N' THEN round(input_tokens * 1e0 / 1e6 + output_tokens * 5e0 / 1e6 + cache_read * 1e-1 / 1e6 + cache_write * 125e-2 / 1e6, 8) ELSE 0e0 END AS cost_usd FROM c)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    names = F.array(*[F.lit(x) for x in "answer_bake repo_summary agent_step translate image_describe question_gen other_tool".split()])
    q = F.col("l_quantity").cast("long")
    rows = li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_orderkey").cast("string").alias("run_id"),
        M.purpose_flag(F.element_at(names, F.col("l_linenumber"))).alias("purpose"), F.concat(F.lit("model-"), "l_returnflag").alias("model"),
        F.concat(F.lit("repo"), F.col("l_suppkey").cast("string")).alias("repo"), F.col("l_linestatus").alias("workflow"), (q * 100).alias("input_tokens"),
        (q * 20).alias("output_tokens"), (F.col("l_partkey") % 100 * 10).alias("cache_read_input_tokens"),
        (F.round(F.col("l_discount") * 100).cast("long") * 4).alias("cache_creation_input_tokens"), (F.round(F.col("l_tax") * 100).cast("long") * 10).alias("thinking_tokens"),
    )
    return M.with_cost(rows, spark.createDataFrame(PRICES, "model string, p_in double, p_out double, p_read double, p_write double"))


_SUM = """count(*)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(thinking)::BIGINT AS thinking_tokens,
 sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, round(sum(cost_usd), 6) AS cost_usd"""


@query("ledger_summary", "M12 M13", f"WITH {_LED} SELECT {_SUM}, count(DISTINCT model)::BIGINT AS models FROM l")
def ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.ledger_summary(ledger(spark, sf))


@query("ledger_breakdown", "M14 M20 M12", f"WITH {_LED} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS bucket, {_SUM} FROM l GROUP BY {d}" for d in ("day", "purpose", "model", "repo", "workflow")))
def ledger_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return M.ledger_breakdown(ledger(spark, sf))


@query("token_classes", "M15", f"""
WITH {_LED}, g AS (SELECT model, sum(CASE WHEN purpose = 'agent_step' THEN 0 ELSE input_tokens END)::BIGINT AS input,
 sum(CASE WHEN purpose = 'agent_step' THEN input_tokens + output_tokens ELSE least(thinking, output_tokens) END)::BIGINT AS thinking,
 sum(CASE WHEN purpose = 'agent_step' THEN 0 ELSE greatest(0, output_tokens - thinking) END)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM l GROUP BY 1)
SELECT *, (input + thinking + output + cache_read + cache_write)::BIGINT AS total FROM g
""")
def token_classes(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_classes(ledger(spark, sf), ["model"])


@query("cost_phase", "M16", f"""
WITH {_LED}, g AS (SELECT CASE WHEN purpose IN ('answer_bake','repo_summary') THEN 'summary' WHEN purpose IN ('agent_step','translate','image_describe') THEN purpose ELSE 'other' END AS phase,
 round(sum(cost_usd), 8) AS cost_usd, count(*)::BIGINT AS calls, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM l GROUP BY 1)
SELECT (CASE phase WHEN 'summary' THEN 1 WHEN 'agent_step' THEN 2 WHEN 'translate' THEN 3 WHEN 'image_describe' THEN 4 ELSE 5 END)::INTEGER AS pos, * FROM g UNION ALL SELECT 0, 'retrieval', 0e0, 0, 0
""")
def cost_phase(spark: SparkSession, sf: str) -> DataFrame:
    return M.cost_phases(ledger(spark, sf))


@query("efficiency", "M19 M18", f"""
WITH {_LED} SELECT sum(CASE WHEN purpose IN ('answer_bake','agent_step') THEN output_tokens ELSE 0 END)::BIGINT AS cited_output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens,
 round(sum(CASE WHEN purpose IN ('answer_bake','agent_step') THEN output_tokens ELSE 0 END) / sum(input_tokens + output_tokens)::DOUBLE, 4) AS efficiency FROM l
""")
def efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return M.efficiency(ledger(spark, sf))


@query("prompt_waste", "M18", f"""
WITH {_LED} SELECT repo, (sum(input_tokens) - sum(output_tokens))::BIGINT AS waste_tokens, round(1e2 * (sum(input_tokens) - sum(output_tokens))::DOUBLE / sum(input_tokens)::DOUBLE, 2) AS waste_pct FROM l GROUP BY 1
""")
def prompt_waste(spark: SparkSession, sf: str) -> DataFrame:
    g = ledger(spark, sf).groupBy("repo").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    w, pct = M.waste(F.col("i"), F.col("o"))
    return g.select("repo", w.alias("waste_tokens"), pct.alias("waste_pct"))


@query("burn_rate", "M22", f"""
WITH {_LED}, t AS (SELECT sum(cost_usd) AS t FROM l WHERE day >= '1998-01-01')
SELECT round(t / (7 * 24e0), 6) AS cost_per_hour, round(t / (7 * 24e0) * 24e0, 6) AS projected_per_day, round(t, 6) AS cost_usd, 168e0 AS hours FROM t
""")
def burn_rate(spark: SparkSession, sf: str) -> DataFrame:
    return M.burn_rate(ledger(spark, sf).where("day >= '1998-01-01'"), 7)


@query("value_overview", "M23", f"""
WITH {_EV}, g AS (SELECT count(*)::BIGINT AS questions, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 6) AS spend_usd,
 round(sum(CASE WHEN cache_hit THEN cost / 2 ELSE 0e0 END), 6) AS cost_avoided_usd, count(DISTINCT subject)::BIGINT AS active_users, round(sum(grounding) / count(*), 4) AS trust_avg FROM a),
v AS (SELECT *, round(tokens_in * 15e0 / 1e6 + tokens_out * 75e0 / 1e6, 6) AS value_usd, round(questions * 6e0 / 60e0, 2) AS hours_saved FROM g)
SELECT *, round(value_usd / spend_usd, 2) AS roi, round(hours_saved * 40e0, 2) AS labour_usd, round(spend_usd / questions, 6) AS cost_per_answer_usd, round(questions / active_users::DOUBLE, 2) AS questions_per_user FROM v
""")
def value_overview(spark: SparkSession, sf: str) -> DataFrame:
    return M.value_overview(spans(spark, sf), 15.0, 75.0, 6.0, 40.0)


@query("growth", "M24", f"""
WITH {_EV}, b AS (SELECT floor(started_at / (7 * 86400))::BIGINT AS bucket, count(*) AS n FROM a GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY bucket) AS p FROM b)
SELECT bucket, round((n - p) / p::DOUBLE, 4) AS growth FROM l ORDER BY bucket DESC LIMIT 1
""")
def growth(spark: SparkSession, sf: str) -> DataFrame:
    return M.growth(M.time_series(spans(spark, sf), 0, 7 * 86400))


@query("reconcile", "M25 M26", f"""
WITH {_EV}, m AS (SELECT count(*)::BIGINT AS n, sum(cost) AS c, count(*) FILTER (level IN ('gap', 'clarify')) AS e FROM a), l AS (SELECT count(*)::BIGINT AS n, sum(cost) AS c FROM a WHERE tier <> 'none' OR k > 2)
SELECT m.n AS answers_a, l.n AS answers_b, round(1e2 * abs(m.n - l.n) / greatest(m.n, l.n), 4) <= 1 AS answers_ok, round(1e2 * abs(m.c - l.c) / greatest(m.c, l.c), 4) AS cost_delta_pct,
 round(1e2 * abs(m.c - l.c) / greatest(m.c, l.c), 4) <= 1 AS cost_ok, round(m.e / m.n::DOUBLE, 4) AS error_rate FROM m, l
""")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Two independent totals: all spans, and the spans that were billed or used more than two units."""
    s = spans(spark, sf)
    billed = (F.col("tier") != "none") | (F.col("k") > 2)
    g = s.agg(
        F.count(F.lit(1)).alias("answers_a"), F.sum("cost").alias("ca"), F.count_if(billed).alias("answers_b"), F.sum(F.when(billed, F.col("cost"))).alias("cb"),
        F.count_if(F.col("level").isin("gap", "clarify")).alias("e"),
    )
    a_ok, _ = M.within(F.col("answers_a"), F.col("answers_b"))
    c_ok, c_d = M.within(F.col("ca"), F.col("cb"))
    return g.select("answers_a", "answers_b", a_ok.alias("answers_ok"), c_d.alias("cost_delta_pct"), c_ok.alias("cost_ok"), F.round(F.col("e") / F.col("answers_a"), 4).alias("error_rate"))


@query("recent_traces", "M26 M34", f"""
WITH {_EV} SELECT id::VARCHAR AS trace_id, subject, level, duration_ms AS latency_ms, level IN ('gap', 'clarify') AS error FROM a ORDER BY started_at DESC, id DESC LIMIT 20
""")
def recent_traces(spark: SparkSession, sf: str) -> DataFrame:
    e = M.flat_events(spans(spark, sf)).orderBy(F.desc("started_at"), F.desc(F.col("trace_id").cast("long"))).limit(20)
    return e.select("trace_id", "subject", "level", "latency_ms", F.col("level").isin("gap", "clarify").alias("error"))


@query("usage_windows", "M27", f"""
WITH {_EV}, w AS (SELECT subject, level, cost, unnest(list_filter([CASE WHEN {NOW} - started_at <= 86400 THEN 'today' END, CASE WHEN {NOW} - started_at <= 7 * 86400 THEN '7d' END, 'all'], lambda x: x IS NOT NULL)) AS win FROM a)
SELECT subject, win AS "window", count(*)::BIGINT AS questions, (count(*) FILTER (level NOT IN ('clarify', 'gap')))::BIGINT AS answered, (count(*) FILTER (level IN ('clarify', 'gap')))::BIGINT AS declined, round(sum(cost), 6) AS cost FROM w GROUP BY ALL
""")
def usage_windows(spark: SparkSession, sf: str) -> DataFrame:
    return M.usage_windows(spans(spark, sf), NOW)


@query("load_stats", "M28", """
WITH q AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'cold' ELSE 'warm' END AS phase, epoch_us(ts) / 1e6 AS at_s, value AS latency_ms, user_id AS trace_id,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'declined' WHEN 'purchase' THEN 'throttled' ELSE 'ok' END AS outcome FROM events),
g AS (SELECT phase, count(*)::BIGINT AS requests, round(count(*) / (max(at_s + latency_ms / 1000) - min(at_s)), 6) AS qps, (count(*) FILTER (outcome = 'error'))::BIGINT AS errors,
 (count(*) FILTER (outcome = 'throttled'))::BIGINT AS throttled, (count(*) FILTER (outcome = 'declined'))::BIGINT AS declined FROM q GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY phase) AS c FROM q WHERE outcome <> 'error'),
p AS (SELECT phase, count(DISTINCT trace_id)::BIGINT AS distinct_traces, max(latency_ms) AS max_ms, max(latency_ms) FILTER (i = floor(c * 5e-1)) AS p50_ms, max(latency_ms) FILTER (i = floor(c * 95e-2)) AS p95_ms, max(latency_ms) FILTER (i = floor(c * 99e-2)) AS p99_ms FROM r GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN errors > 0 THEN 'errors' END, CASE WHEN throttled > 0 THEN 'throttled' END, CASE WHEN distinct_traces <> requests - errors THEN 'trace bleed' END,
 CASE WHEN p95_ms > 750 THEN 'p95' END, CASE WHEN qps < 20 THEN 'qps' END], lambda x: x IS NOT NULL), ',') AS breaches FROM g JOIN p USING (phase)
""")
def load_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    out = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "declined").when(F.col("event_type") == "purchase", "throttled").otherwise("ok")
    q = e.select(
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "cold").otherwise("warm").alias("phase"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"),
        F.col("value").alias("latency_ms"), F.col("user_id").alias("trace_id"), out.alias("outcome"),
    )
    return M.load_stats(q)


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    r = o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("tenant"), F.col("o_orderpriority").alias("agent"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_totalprice").alias("amount"),
    )
    c = table(spark, sf, "customer")
    caps = c.select(F.col("c_custkey").cast("string").alias("tenant"), F.lit(None).cast("string").alias("agent"), (F.col("c_acctbal") * 200).alias("cap"))
    agents = c.select(F.col("c_custkey").cast("string").alias("tenant"), F.lit("1-URGENT").alias("agent"), (F.col("c_acctbal") * 50).alias("cap"))
    return r, caps.unionByName(agents)


@query("budget_admission", "M29 P6")
def budget_admission(spark: SparkSession, sf: str) -> DataFrame:
    r, caps = _requests(spark, sf)
    return M.budget_admission(r, caps).select("request_id", "tenant", "amount", "admitted")


@query("budget_remaining", "M30", """
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey::VARCHAR AS tenant, round(c_acctbal * 200 - spent, 4) AS remaining FROM customer JOIN s ON o_custkey = c_custkey
""")
def budget_remaining(spark: SparkSession, sf: str) -> DataFrame:
    r, caps = _requests(spark, sf)
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("tenant")).agg(F.sum("o_totalprice").alias("spent"))
    b = caps.where("agent is null").select("tenant", "cap").join(o, "tenant")
    return M.budget_remaining(b.select("tenant"), b).select("tenant", F.round("remaining", 4).alias("remaining"))


@query("rate_limit", "T4")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.lit("t1").alias("tenant"), F.col("user_id").cast("string").alias("subject"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return M.rate_limit(e, limit=3, window_s=86400.0)


@query("audit_views", "M31", """
SELECT event_id AS id, epoch_us(ts) // 1000 AS at, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def audit_views(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").select(F.lit("t1").alias("tenant"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("action"))
    return M.audit_for_tenant(a, "t1", 100).select("id", "at", "action")


@query("audit_trace", "M31", f"""
WITH {_TRACE} SELECT id, started_at AS at, name AS action FROM t WHERE trace_id = (SELECT arg_max(trace_id, id) FROM t)
""")
def audit_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The audit rows of the trace that the last row belongs to."""
    a = trace_table(spark, sf).select("tenant", "trace_id", "id", F.col("started_at").alias("at"), F.col("name").alias("action"))
    return M.audit_by_trace(a, "t1", a.agg(F.max_by("trace_id", "id").alias("trace_id")).first()["trace_id"]).select("id", "at", "action")


@query("source_cards", "M33", """
WITH c AS (SELECT source, count(*)::BIGINT AS documents, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY 1),
h AS (SELECT source, count(*)::BIGINT AS labelled, round(avg(quality), 6) AS quality, (count(*) FILTER (toxic = 1))::BIGINT AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT c.source, documents, characters, labelled, quality, toxic FROM c LEFT JOIN h ON h.source = c.source
""")
def source_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Every source with its documents, and the state of its labels where it has any."""
    d = table(spark, sf, "documents")
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))
    h = table(spark, sf, "labels").join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("labelled"), F.round(F.avg("quality"), 6).alias("quality"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    return M.source_cards(counts, h)


@query("open_queue", "M32", """
SELECT event_id AS id, epoch_us(ts) // 1000 AS created_at FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k')::BIGINT > 50
""")
def open_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"),
        F.when(F.col("event_type") == "error", "gap").otherwise("feedback").alias("kind"), F.when(F.get_json_object("props", "$.k").cast("long") > 50, "open").otherwise("done").alias("status"),
    )
    return M.open_items(q, "gap").select("id", "created_at")


@query("incremental_spans", "M34", f"""
WITH {_EV} SELECT id, started_at FROM a WHERE started_at >= {NOW} - 5 * 86400
""")
def incremental_spans(spark: SparkSession, sf: str) -> DataFrame:
    return M.read_spans(spans(spark, sf), "t1", NOW - 5 * 86400).select("id", "started_at")


@query("repeat_answers", "R41 R40", r"""
WITH x AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q, length(text) AS n, role FROM conversations WHERE role <> 'assistant'),
f AS (SELECT q, role, min((conv_id, turn, n)) AS f FROM x GROUP BY ALL)
SELECT conv_id, turn, (conv_id, turn) <> (f[1], f[2]) AS cache_hit, CASE WHEN (conv_id, turn) <> (f[1], f[2]) THEN round(f[3] * 5e-2 / 1e6, 8) ELSE 0e0 END AS cost_saved FROM x JOIN f USING (q, role)
""")
def repeat_answers(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import repeat_key_text

    c = table(spark, sf, "conversations").where("role <> 'assistant'")
    asks = c.select(
        F.struct("conv_id", "turn").alias("ask_id"), F.lit("t1").alias("tenant"), repeat_key_text("text").alias("question_key"), F.lit("public").alias("access"),
        F.col("role").alias("persona"), F.col("conv_id").alias("at"), M.imputed_cost(F.length("text"), F.lit(0)).alias("cost"),
    )
    return M.repeat_answers(asks).select("ask_id.conv_id", "ask_id.turn", "cache_hit", "cost_saved")
