"""Telemetry, cost and service analytics over span and ledger tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import floor_index, nearest_rank, round_index, shuffled

WHY = "level_name string, explain string, reasons array<struct<code: string, detail: string>>"


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(0.0)


def window_filter(spans: DataFrame, now_s: float, horizon_s: float, subject: str | None = None, role: str | None = None) -> DataFrame:
    """Answer spans from the window floor on, optionally of one subject or one role of the comma list."""
    out = spans.where((F.col("name") == "answer") & (F.col("started_at") >= now_s - horizon_s))
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    if role is not None:
        out = out.where(F.array_contains(F.split("roles", ","), role))
    return out


def answer_metrics(spans: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Counts, sums, rates and nearest-rank latency per tenant."""
    a = spans.where("name = 'answer'")
    n = F.count(F.lit(1))
    m = a.groupBy(*keys).agg(
        n.alias("answers"), F.round(F.sum("cost"), 6).alias("total_cost"), F.sum("tokens").alias("total_tokens"),
        F.round(F.sum("grounding") / n, 4).alias("grounding_avg"),
        ratio(F.count_if(F.col("citations_count") > 0), n).alias("citation_coverage"),
        ratio(F.count_if(F.col("level") == "clarify"), n).alias("clarify_back_rate"),
    )
    p = nearest_rank(a, list(keys), "duration_ms", {"latency_p50_ms": floor_index(0.5), "latency_p95_ms": floor_index(0.95)})
    return m.join(p.drop("n"), list(keys))


def cost_by(spans: DataFrame) -> DataFrame:
    """Cost by tier and by stage in one pass."""
    g = spans.groupingSets([["tier"], ["stage"]], "tier", "stage").agg(
        F.round(F.sum("cost"), 6).alias("cost"), F.grouping("stage").alias("_g")
    )
    return g.select(
        F.when(F.col("_g") == 1, "tier").otherwise("stage").alias("dimension"),
        F.when(F.col("_g") == 1, F.coalesce("tier", F.lit("none"))).otherwise(F.coalesce("stage", F.lit("?"))).alias("bucket"), "cost",
    )


def routing(answers: DataFrame) -> DataFrame:
    """Counts by level, tier, complexity, model and reason code: (dimension, bucket, n)."""
    model = F.when(F.coalesce("model_name", F.lit("")) != "", F.col("model_name")).when(
        F.coalesce("tier", F.lit("none")).isin("", "none"), "none (extractive)"
    ).otherwise("?")
    dims = [
        ("level", F.coalesce("level", F.lit("?"))), ("tier", F.coalesce("tier", F.lit("none"))),
        ("complexity", F.coalesce("complexity", F.lit("n/a"))), ("model", model),
    ]
    reasons = F.transform(
        F.coalesce(F.from_json("why", WHY)["reasons"], F.array()),
        lambda r: F.struct(F.lit("reason").alias("dimension"), F.coalesce(r["code"], F.lit("?")).alias("bucket")),
    )
    flat = F.concat(F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("bucket")) for d, c in dims]), reasons)
    return answers.select(F.explode(flat).alias("x")).groupBy("x.dimension", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def savings(answers: DataFrame) -> DataFrame:
    hits = answers.where("cache_hit")
    return hits.groupBy(F.coalesce(F.nullif(F.col("cache_technique"), F.lit("")), F.lit("other")).alias("technique")).agg(
        F.count(F.lit(1)).alias("hits"), F.round(F.sum(F.coalesce("cost_saved", F.lit(0.0))), 6).alias("saved")
    )


def rollup_users(answers: DataFrame) -> DataFrame:
    return answers.groupBy(F.coalesce("subject", F.lit("?")).alias("subject")).agg(
        F.count(F.lit(1)).alias("answers"), F.round(F.sum("cost"), 6).alias("cost"), F.sum("tokens").alias("tokens")
    )


def rollup_roles(answers: DataFrame) -> DataFrame:
    """A row with several roles counts in each."""
    r = answers.select(F.explode(F.split(F.coalesce("roles", F.lit("")), ",")).alias("role"), "cost").where("role <> ''")
    return r.groupBy("role").agg(F.count(F.lit(1)).alias("answers"), F.round(F.sum("cost"), 6).alias("cost"))


def time_series(answers: DataFrame, floor_s: float, bucket_s: int) -> DataFrame:
    """Buckets counted from the window floor, with mean latency and a split by level."""
    b = F.floor((F.col("started_at") - F.lit(floor_s)) / bucket_s).alias("bucket")
    lv = answers.groupBy(b, F.coalesce("level", F.lit("?")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("c"), F.sum("tokens_in").alias("ti"), F.sum("tokens_out").alias("to_"),
        F.sum(F.coalesce("cost_saved", F.lit(0.0))).alias("cs"), F.sum("duration_ms").alias("d"),
    )
    return lv.groupBy("bucket").agg(
        F.sum("n").alias("answers"), F.round(F.sum("c"), 6).alias("cost"), F.sum("ti").alias("tokens_in"), F.sum("to_").alias("tokens_out"),
        F.round(F.sum("cs"), 6).alias("cost_saved"), F.round(F.sum("d") / F.sum("n"), 1).alias("latency_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("by_level"),
    )


def spread_counts(answers: DataFrame) -> DataFrame:
    """Answers by language and persona with their defaults, and how many used the conversation."""
    persona = F.coalesce(F.nullif(F.get_json_object("attrs", "$.persona"), F.lit("")), F.lit("general"))
    ctx = F.coalesce(F.get_json_object("attrs", "$.context_resolved") == "true", F.lit(False))
    flat = F.array(
        F.struct(F.lit("language").alias("dimension"), F.coalesce("lang", F.lit("en")).alias("bucket")),
        F.struct(F.lit("persona").alias("dimension"), persona.alias("bucket")),
    )
    x = answers.select(F.explode(flat).alias("x"), ctx.cast("long").alias("r"))
    return x.groupBy("x.dimension", "x.bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("context_resolved"))


def flat_events(spans: DataFrame) -> DataFrame:
    """One wide row per answer with a default for every dimension."""
    a = lambda k: F.nullif(F.get_json_object("attrs", f"$.{k}"), F.lit(""))
    kind = F.coalesce(a("kind"), F.when(F.col("level").isin("gap", "clarify"), "gap").otherwise("answer"))
    role = F.element_at(F.split(F.element_at(F.split(F.coalesce(F.nullif(F.col("roles"), F.lit("")), F.lit("asker")), ","), 1), r"\."), 1)
    return spans.where("name = 'answer'").select(
        "tenant", "trace_id", F.coalesce("subject", F.lit("")).alias("subject"), role.alias("role"),
        F.coalesce(a("persona"), F.lit("general")).alias("persona"), F.coalesce(a("scope"), F.lit("public")).alias("scope"),
        F.when(F.coalesce(a("context_resolved") == "true", F.lit(False)), "resolved").otherwise("direct").alias("context"),
        F.coalesce(F.from_json("why", WHY)["level_name"], "level").alias("level"), F.coalesce("tier", F.lit("none")).alias("tier"),
        F.coalesce(a("source_kind"), F.lit("")).alias("source_kind"), F.coalesce("model_name", F.lit("demo model")).alias("model"),
        F.upper(F.coalesce("lang", F.lit("en"))).alias("lang"), F.coalesce("complexity", F.lit("simple")).alias("complexity"),
        kind.alias("kind"), (kind == "answer").cast("int").alias("answered"), (kind != "answer").cast("int").alias("declined"),
        (F.col("citations_count") > 0).cast("int").alias("cited"), "tokens_in", "tokens_out", F.round("cost", 6).alias("cost"),
        F.round(F.coalesce("cost_saved", F.lit(0.0)), 6).alias("cost_saved"), F.round("duration_ms", 2).alias("latency_ms"),
        F.round("grounding", 4).alias("grounding"), "started_at",
    )


def trace_spans(spans: DataFrame, tenant: str, trace_id: str) -> DataFrame:
    return spans.where((F.col("tenant") == tenant) & (F.col("trace_id") == trace_id)).orderBy("id")


def waterfall(spans: DataFrame) -> DataFrame:
    """Offset from the first span of the trace and duration, per span; first and end by aggregate."""
    end = F.col("started_at") + F.col("duration_ms") / 1000.0
    g = spans.groupBy("trace_id").agg(F.min("started_at").alias("_t0"), F.max(end).alias("_t1"))
    j = spans.join(g, "trace_id")
    return j.select(
        "trace_id", "id", "name", F.round((F.col("started_at") - F.col("_t0")) * 1000, 2).alias("offset_ms"),
        F.round("duration_ms", 2).alias("duration_ms"), F.round((F.col("_t1") - F.col("_t0")) * 1000, 2).alias("total_ms"),
    )


def stab_join(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """All (point row, interval row) with equal keys and start <= point <= end.

    Intervals are put in classes by length (powers of two); an interval of a class of width w
    covers at most two w-wide cells, and a point probes one cell per class present under its key.
    The join is then an equi join on (key, class, cell), not every point with every interval.
    """
    keys = list(keys)
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(end) - F.col(start), F.lit(1.0))))).cast("int")
    iv = intervals.withColumn("_cls", width).withColumn("_w", F.pow(F.lit(2.0), F.col("_cls")))
    lo, hi = F.floor(F.col(start) / F.col("_w")), F.floor(F.col(end) / F.col("_w"))
    iv = iv.withColumn("_cell", F.explode(F.sequence(lo, hi))).drop("_w")
    cls = iv.select(*keys, "_cls").distinct()
    p = points.join(shuffled(cls), keys).withColumn("_cell", F.floor(F.col(point) / F.pow(F.lit(2.0), F.col("_cls"))))
    j = p.join(shuffled(iv), [*keys, "_cls", "_cell"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end)))
    return j.drop("_cls", "_cell")


def span_parents(spans: DataFrame) -> DataFrame:
    """Parent of each span: the longest dotted prefix present in the trace, preferring the first
    span of that name whose window holds the child's start; a dotted span without one hangs under
    the trace's single root.

    ``spans``: (trace_id, id, name, started_at, duration_ms). Order in a trace is (started_at, id).
    """
    s = spans.select("trace_id", "id", "name", "started_at", (F.col("started_at") + F.col("duration_ms") / 1000.0).alias("ends_at"))
    parts = F.split("name", r"\.")
    cuts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts))
    pre = s.select("trace_id", "id", F.col("started_at").alias("at"), F.explode(F.transform(cuts, lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
    names = s.groupBy("trace_id", F.col("name").alias("prefix")).agg(F.min(F.struct("started_at", "id")).alias("f"))
    have = pre.join(names, ["trace_id", "prefix"])
    longest = have.groupBy("trace_id", "id").agg(F.max_by(F.struct("prefix", "at", "f"), F.length("prefix")).alias("b"))
    longest = longest.select("trace_id", "id", F.col("b.prefix").alias("prefix"), F.col("b.at").alias("at"), F.col("b.f.id").alias("first_id"))
    cand = s.select(
        "trace_id", F.col("name").alias("prefix"), (F.col("started_at") - 1e-3).alias("lo"), (F.col("ends_at") + 1e-3).alias("hi"),
        F.col("started_at").alias("cs"), F.col("id").alias("cid"),
    )
    inside = stab_join(longest, "at", cand, "lo", "hi", ["trace_id", "prefix"]).groupBy("trace_id", "id").agg(F.min(F.struct("cs", "cid")).alias("e"))
    roots = s.where(~F.col("name").contains(".")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("nr"), F.min("id").alias("root"))
    j = s.select("trace_id", "id", "name").join(longest.select("trace_id", "id", "first_id"), ["trace_id", "id"], "left")
    j = j.join(inside, ["trace_id", "id"], "left").join(roots, "trace_id", "left")
    only = F.when(F.col("name").contains(".") & (F.col("nr") == 1) & (F.col("root") != F.col("id")), F.col("root"))
    return j.select("trace_id", "id", "name", F.coalesce(F.col("e.cid"), F.col("first_id"), only).alias("parent_id"))


def trace_export(spans: DataFrame) -> DataFrame:
    """Export rows: deterministic hex ids, nanosecond times, status and key attributes, one row per span.

    Write it with ``write.partitionBy("tenant").json(...)``: a file per tenant partition, never one
    value holding all spans of a tenant.
    """
    hexid = lambda *c: F.sha2(F.concat_ws("|", *c), 256)
    par = span_parents(spans).select("trace_id", "id", "parent_id")
    j = spans.join(par, ["trace_id", "id"])
    sid = lambda c: F.substring(hexid(F.col("trace_id").cast("string"), c.cast("string")), 1, 16)
    start = F.round(F.col("started_at") * 1e9).cast("long")
    return j.select(
        "tenant", F.substring(hexid(F.col("trace_id").cast("string")), 1, 32).alias("traceId"), sid(F.col("id")).alias("spanId"),
        F.when(F.col("parent_id").isNotNull(), sid(F.col("parent_id"))).alias("parentSpanId"), "name",
        start.cast("string").alias("startTimeUnixNano"),
        (start + F.round(F.greatest(F.col("duration_ms"), F.lit(0.0)) * 1e6).cast("long")).cast("string").alias("endTimeUnixNano"),
        F.when(F.col("status") == "error", 2).otherwise(1).alias("statusCode"),
    )


def fast_path(level: Column, tier: Column) -> Column:
    low = F.lower(F.coalesce(level, F.lit("")))
    return ~(low.startswith("reason") | low.startswith("escalation") | F.coalesce(tier, F.lit("none")).isin("deep", "escalation"))


def service_levels(events: DataFrame, dimension: str, explains: DataFrame | None = None) -> DataFrame:
    """Per value of ``dimension``: n, p50, p95, fast and agent share, cost and explain requests per answer."""
    e = events.where("answered = 1").withColumn("_f", fast_path(F.col("level"), F.col("tier")))
    n = F.count(F.lit(1))
    m = e.groupBy(dimension).agg(
        n.alias("n"), F.round(F.count_if("_f") / n, 3).alias("fast_share"), F.round(F.count_if(~F.col("_f")) / n, 3).alias("agent_share"),
        F.round(F.sum("cost") / n, 6).alias("cost_per_answer"),
    )
    p = nearest_rank(e, [dimension], "latency_ms", {"p50_ms": round_index(0.5), "p95_ms": round_index(0.95)}).drop("n")
    out = m.join(p, dimension)
    if explains is not None:
        x = explains.groupBy(dimension).agg(F.count(F.lit(1)).alias("_x"))
        out = out.join(x, dimension, "left").withColumn("explain_rate", F.round(F.coalesce("_x", F.lit(0)) / F.col("n"), 3)).drop("_x")
    return out


def explain_counts(spans: DataFrame) -> DataFrame:
    """Explain requests by persona and in total (persona null)."""
    persona = F.coalesce(F.nullif(F.get_json_object("attrs", "$.persona"), F.lit("")), F.lit("general"))
    return spans.where("name = 'explain.requested'").select(persona.alias("persona")).rollup("persona").agg(F.count(F.lit(1)).alias("n"))


# ---- ledger -------------------------------------------------------------------------------
# Known purposes, phases of an answer, purposes that are thinking or answers.
PURPOSES = (
    "repo_summary capability_classify answer_bake ask_queue agent_step translate image_describe "
    "question_gen table_sql quality_harness doctor_ping explain"
).split()
PHASES = {"answer_bake": "summary", "repo_summary": "summary", "agent_step": "agent_step", "translate": "translate", "image_describe": "image_describe"}
PHASE_ORDER = ("retrieval", "summary", "agent_step", "translate", "image_describe", "other")
OSS_USD_PER_MTOK = 0.05


def purpose_flag(p: Column) -> Column:
    return F.when(p.isin(*PURPOSES), p).otherwise(F.concat(F.lit("unknown:"), p))


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from per-million prices; an unknown model costs 0."""
    j = calls.join(prices.select("model", "p_in", "p_out", "p_read", "p_write"), "model", "left")
    parts = (
        F.col("input_tokens") * F.coalesce("p_in", F.lit(0.0)) / 1e6 + F.col("output_tokens") * F.coalesce("p_out", F.lit(0.0)) / 1e6
        + F.col("cache_read_input_tokens") * F.coalesce("p_read", F.lit(0.0)) / 1e6 + F.col("cache_creation_input_tokens") * F.coalesce("p_write", F.lit(0.0)) / 1e6
    )
    return j.withColumn("cost_usd", F.round(parts, 8)).drop("p_in", "p_out", "p_read", "p_write")


def imputed_cost(tin: Column, tout: Column, rate: float = OSS_USD_PER_MTOK) -> Column:
    z = F.lit(0)
    return F.round((F.greatest(z, tin) + F.greatest(z, tout)) * rate / 1e6, 8)


def _summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("thinking_tokens").alias("thinking_tokens"), F.sum("cache_read_input_tokens").alias("cache_read"),
        F.sum("cache_creation_input_tokens").alias("cache_write"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    ]


def ledger_summary(ledger: DataFrame, run: str | None = None) -> DataFrame:
    rows = ledger if run is None else ledger.where(F.col("run_id") == run)
    return rows.agg(*_summary(), F.count_distinct("model").alias("models"))


def ledger_breakdown(ledger: DataFrame, dims: Sequence[str] = ("day", "purpose", "model", "repo", "workflow")) -> DataFrame:
    """The summary by every dimension, in one pass: (dimension, bucket, ...)."""
    out = ledger.groupingSets([[d] for d in dims], *dims).agg(*_summary(), F.grouping_id().alias("_g"))
    m = len(dims)
    which = bucket = None
    for i, d in enumerate(dims):
        bit = (1 << m) - 1 - (1 << (m - 1 - i))
        cond = F.col("_g") == bit
        which = F.when(cond, d) if which is None else which.when(cond, d)
        bucket = F.when(cond, F.col(d).cast("string")) if bucket is None else bucket.when(cond, F.col(d).cast("string"))
    return out.withColumn("dimension", which).withColumn("bucket", F.coalesce(bucket, F.lit("—"))).drop("_g", *dims)


def token_classes(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Input, thinking, output, cache read and cache write without double counting."""
    think = F.col("purpose") == "agent_step"
    i, o, t = F.col("input_tokens"), F.col("output_tokens"), F.col("thinking_tokens")
    g = ledger.groupBy(*keys).agg(
        F.sum(F.when(think, 0).otherwise(i)).alias("input"),
        F.sum(F.when(think, i + o).otherwise(F.least(t, o))).alias("thinking"),
        F.sum(F.when(think, 0).otherwise(F.greatest(F.lit(0), o - t))).alias("output"),
        F.sum("cache_read_input_tokens").alias("cache_read"), F.sum("cache_creation_input_tokens").alias("cache_write"),
    )
    return g.withColumn("total", F.col("input") + F.col("thinking") + F.col("output") + F.col("cache_read") + F.col("cache_write"))


def cost_phases(ledger: DataFrame) -> DataFrame:
    """Cost, calls and tokens by answer phase in fixed order; retrieval is always there at zero."""
    phase = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in PHASES.items() for x in (F.lit(k), F.lit(v))]), F.col("purpose")), F.lit("other"))
    g = ledger.groupBy(phase.alias("phase")).agg(
        F.round(F.sum("cost_usd"), 8).alias("cost_usd"), F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    )
    names = ledger.sparkSession.createDataFrame([(i, p) for i, p in enumerate(PHASE_ORDER)], "pos int, phase string")
    j = names.join(g, "phase", "left").where("calls is not null or phase = 'retrieval'")
    return j.select("pos", "phase", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def efficiency(ledger: DataFrame) -> DataFrame:
    cited = F.sum(F.when(F.col("purpose").isin("answer_bake", "agent_step"), F.col("output_tokens")).otherwise(0))
    total = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    g = ledger.agg(cited.alias("cited_output_tokens"), total.alias("total_tokens"))
    return g.withColumn("efficiency", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("cited_output_tokens"), F.col("total_tokens")))))


def burn_rate(ledger: DataFrame, days: int) -> DataFrame:
    hours = max(1, days) * 24.0
    g = ledger.agg(F.sum("cost_usd").alias("t"))
    return g.select(
        F.round(F.col("t") / hours, 6).alias("cost_per_hour"), F.round(F.col("t") / hours * 24.0, 6).alias("projected_per_day"),
        F.round("t", 6).alias("cost_usd"), F.lit(hours).alias("hours"),
    )


def active_idle(events: DataFrame) -> DataFrame:
    """Per-answer active and idle time from a ``phase_ms`` map and ``total_ms``; active never exceeds the wall clock."""
    act = F.least(F.aggregate(F.map_values("phase_ms"), F.lit(0.0), lambda a, x: a + x), F.col("total_ms"))
    e = events.withColumn("_a", act).withColumn("_i", F.greatest(F.lit(0.0), F.col("total_ms") - F.col("_a")))
    tot = F.col("_a") + F.col("_i")
    pct = F.when(tot > 0, F.round(100.0 * F.col("_a") / tot, 2)).otherwise(0.0)
    return e.withColumn("active_ms", F.round("_a", 2)).withColumn("idle_ms", F.round("_i", 2)).withColumn("active_pct", pct).drop("_a", "_i")


def waste(prompt: Column, cited: Column) -> tuple[Column, Column]:
    """Prompt tokens that reached no cited sentence, and their share in percent."""
    w = F.greatest(F.lit(0), prompt - cited)
    return w, F.when(prompt > 0, F.round(100.0 * w / prompt, 2)).otherwise(0.0)


def timing_percentiles(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """p50, p95 and p99 per key by index int(n * p)."""
    return nearest_rank(values, keys, value, {"p50": floor_index(0.50), "p95": floor_index(0.95), "p99": floor_index(0.99)})


def growth(series: DataFrame) -> DataFrame:
    """Last non-empty bucket over the one before, minus one. ``series`` has one row per bucket."""
    w = Window.orderBy("bucket")
    s = series.where("answers > 0").withColumn("prev", F.lag("answers").over(w))
    last = s.agg(F.max_by(F.struct("bucket", "answers", "prev"), "bucket").alias("b"))
    g = F.when(F.col("b.prev") > 0, F.round((F.col("b.answers") - F.col("b.prev")) / F.col("b.prev"), 4)).otherwise(0.0)
    return last.select(F.col("b.bucket").alias("bucket"), g.alias("growth"))


def within(x: Column, y: Column, pct: float = 1.0) -> tuple[Column, Column]:
    base = F.greatest(F.abs(x), F.abs(y))
    delta = F.when(base > 0, F.round(100.0 * F.abs(x - y) / base, 4)).otherwise(0.0)
    return delta <= pct, delta


def value_overview(answers: DataFrame, frontier_in: float, frontier_out: float, minutes: float, rate: float) -> DataFrame:
    """Value, cost, adoption and quality of a window in one row."""
    n = F.count(F.lit(1))
    g = answers.agg(
        n.alias("questions"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("spend_usd"),
        F.round(F.sum(F.coalesce("cost_saved", F.lit(0.0))), 6).alias("cost_avoided_usd"), F.count_distinct("subject").alias("active_users"),
        F.round(F.sum("grounding") / n, 4).alias("trust_avg"),
    )
    v = F.round(F.col("tokens_in") * frontier_in / 1e6 + F.col("tokens_out") * frontier_out / 1e6, 6)
    hours = F.round(F.col("questions") * minutes / 60.0, 2)
    return (
        g.withColumn("value_usd", v).withColumn("roi", F.when(F.col("spend_usd") > 0, F.round(F.col("value_usd") / F.col("spend_usd"), 2)))
        .withColumn("hours_saved", hours).withColumn("labour_usd", F.round(F.col("hours_saved") * rate, 2))
        .withColumn("cost_per_answer_usd", F.when(F.col("questions") > 0, F.round(F.col("spend_usd") / F.col("questions"), 6)).otherwise(0.0))
        .withColumn("questions_per_user", F.when(F.col("active_users") > 0, F.round(F.col("questions") / F.col("active_users"), 2)).otherwise(0.0))
    )


def usage_windows(spans: DataFrame, now_s: float) -> DataFrame:
    """Asked, answered and declined per subject for the last day, week and all time, in one pass."""
    a = spans.where("name = 'answer'")
    age = F.lit(now_s) - F.col("started_at")
    wins = F.array_compact(F.array(F.when(age <= 86400, "today"), F.when(age <= 7 * 86400, "7d"), F.lit("all")))
    x = a.select("subject", "level", "cost", F.explode(wins).alias("window"))
    dec = F.count_if(F.col("level").isin("clarify", "gap"))
    return x.groupBy("subject", "window").agg(
        F.count(F.lit(1)).alias("questions"), (F.count(F.lit(1)) - dec).alias("answered"), dec.alias("declined"), F.round(F.sum("cost"), 6).alias("cost")
    )


# Load objectives.
SLO_P95_MS, SLO_MIN_QPS, WARM_FACTOR = 750.0, 20.0, 0.9


def load_stats(requests: DataFrame) -> DataFrame:
    """Throughput, latency and outcome counts per phase of a request log (phase, at_s, latency_ms, outcome, trace_id)."""
    ok = requests.where("outcome <> 'error'")
    n = F.count(F.lit(1))
    wall = F.max(F.col("at_s") + F.col("latency_ms") / 1000) - F.min("at_s")
    g = requests.groupBy("phase").agg(
        n.alias("requests"), F.round(n / wall, 6).alias("qps"), F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "throttled").alias("throttled"), F.count_if(F.col("outcome") == "declined").alias("declined"),
    )
    t = ok.groupBy("phase").agg(F.count_distinct("trace_id").alias("distinct_traces"), F.max("latency_ms").alias("max_ms"))
    p = nearest_rank(ok, ["phase"], "latency_ms", {"p50_ms": floor_index(0.5), "p95_ms": floor_index(0.95), "p99_ms": floor_index(0.99)}).drop("n")
    out = g.join(t, "phase").join(p, "phase")
    bad = F.array_compact(F.array(
        F.when(F.col("errors") > 0, "errors"), F.when(F.col("throttled") > 0, "throttled"),
        F.when(F.col("distinct_traces") != F.col("requests") - F.col("errors"), "trace bleed"),
        F.when(F.col("p95_ms") > SLO_P95_MS, "p95"), F.when(F.col("qps") < SLO_MIN_QPS, "qps"),
    ))
    return out.withColumn("breaches", F.array_join(bad, ","))


def ordered_fold(df: DataFrame, key: Sequence[str], order: Sequence[str], step, init, out: str, schema_type: str) -> DataFrame:
    """Run a small state machine over each key's rows in time order.

    Rows are hash-partitioned by key and sorted within the partition; a task walks its rows batch by
    batch holding one state per key at a time, so memory does not grow with a key's history.
    ``step(state, row) -> (state, output)``.
    """
    key, order = list(key), list(order)
    arranged = df.repartition(*key).sortWithinPartitions(*key, *order)
    cols = df.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for b in batches:
            got = []
            for row in b.itertuples(index=False):
                k = tuple(getattr(row, c) for c in key)
                if k != current:
                    current, state = k, init(row)
                state, o = step(state, row)
                got.append(o)
            b = b.copy()
            b[out] = got
            yield b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return arranged.mapInPandas(walk, f"{fields}, `{out}` {schema_type}").select(*cols, out)


def budget_admission(requests: DataFrame, caps: DataFrame) -> DataFrame:
    """Admit a request only while the tenant's and its agent's totals stay within their caps.

    ``requests``: (request_id, tenant, agent, at, amount); ``caps``: (tenant, agent or null, cap).
    A refused request consumes nothing, so this is an ordered fold and not a running sum.
    """
    t = caps.where("agent is null").select("tenant", F.col("cap").alias("tcap"))
    a = caps.where("agent is not null").select("tenant", "agent", F.col("cap").alias("acap"))
    r = requests.join(t, "tenant", "left").join(a, ["tenant", "agent"], "left").fillna(float("inf"), ["tcap", "acap"])

    def step(state, row):
        spent, agents = state
        mine = agents.get(row.agent, 0.0)
        if spent + row.amount > row.tcap + 1e-12 or mine + row.amount > row.acap + 1e-12:
            return state, False
        agents[row.agent] = mine + row.amount
        return (spent + row.amount, agents), True

    return ordered_fold(r, ["tenant"], ["at", "request_id"], step, lambda row: (0.0, {}), "admitted", "boolean").drop("tcap", "acap")


def rate_limit(events: DataFrame, limit: int = 60, window_s: float = 60.0) -> DataFrame:
    """At most ``limit`` events per window that starts at the user's first event and restarts once it ran out.

    ``events``: (event_id, tenant, subject, at in seconds).
    """

    def step(state, row):
        start, n = state
        if start is None or row.at - start > window_s:
            return (row.at, 1), True
        if n >= limit:
            return state, False
        return (start, n + 1), True

    return ordered_fold(events, ["tenant", "subject"], ["at", "event_id"], step, lambda row: (None, 0), "allowed", "boolean")


def budget_remaining(tenants: DataFrame, budgets: DataFrame) -> DataFrame:
    """Cap minus spent; infinite for a tenant without a budget."""
    j = tenants.join(budgets, "tenant", "left")
    return j.select("tenant", F.coalesce(F.col("cap") - F.col("spent"), F.lit(float("inf"))).alias("remaining"))


def audit_for_tenant(audit: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    return audit.where(F.col("tenant") == tenant).orderBy(F.desc("at"), F.desc("id")).limit(limit)


def audit_by_trace(audit: DataFrame, tenant: str, trace_id: str) -> DataFrame:
    return audit.where((F.col("tenant") == tenant) & (F.col("trace_id") == trace_id)).orderBy("at", "id")


def open_items(queue: DataFrame, kind: str) -> DataFrame:
    return queue.where((F.col("kind") == kind) & (F.col("status") == "open")).orderBy(F.desc("created_at"), F.desc("id"))


def read_spans(spans: DataFrame, tenant: str, since: float, after_id: str | int | None = None, limit: int | None = None) -> DataFrame:
    """A tenant's spans from a cursor on: started_at ``since``, and ids after ``after_id`` at that very time.

    A page of ``limit`` rows ends with the next cursor, so spans that start together are never passed over.
    """
    at, start = F.col("started_at"), F.lit(since)
    new = at >= start if after_id is None else (at > start) | ((at == start) & (F.col("id") > after_id))
    out = spans.where((F.col("tenant") == tenant) & new)
    return out if limit is None else out.orderBy("started_at", "id").limit(limit)


def source_cards(counts: DataFrame, health: DataFrame) -> DataFrame:
    return counts.join(health, "source", "left")


def repeat_answers(asks: DataFrame, cost: str = "cost") -> DataFrame:
    """Asks that an earlier identical ask already answered, with the cost saved.

    ``asks``: (ask_id, tenant, question_key, access, persona, at, cost). The first ask of a key is
    found by aggregate, so a key asked millions of times is combined before the shuffle.
    """
    keys = ["tenant", "question_key", "access", "persona"]
    first = asks.groupBy(*keys).agg(F.min(F.struct("at", "ask_id", cost)).alias("f"))
    j = asks.join(first, keys)
    hit = F.col("ask_id") != F.col("f.ask_id")
    return j.select("ask_id", *keys, hit.alias("cache_hit"), F.when(hit, F.col(f"f.{cost}")).otherwise(0.0).alias("cost_saved"))
