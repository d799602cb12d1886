"""Exact facts: counts and rankings over documents, issues, sheets, repositories, dependencies, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import top_k

# Done-like states, question patterns of the fact ladder, readiness verdicts.
DONE_LIKE = ("done", "closed", "resolved", "cancelled", "canceled", "won't do", "wont do", "released")
LADDER = [
    ("examples", r"\b(example|examples|implementation|implementations)\s+of\b"),
    ("reusable", r"\breusable\b|\breuse\b|\bre-usable\b"),
    ("css", r"\bcss\b|\bstylesheets?\b|\bstyle sheets?\b"),
    ("licences", r"licen[cs]e|dependenc|librar|packages?\b|third[- ]party"),
    ("enterprise", r"enterprise|production[- ]?ready|production[- ]grade|scalable|ready for production|scal(e|ability)"),
    ("architecture", r"\barchitecture\b|\bdesigned\b|\btechniques?\b"),
    ("who", r"\bwho\b|\bcontributors?\b|\bassignees?\b"),
    ("repo", r"\bcommits?\b|\bpull requests?\b|\bprs?\b|\breleases?\b|\bdeploy|\bworkflows?\b|\blanguages?\b"),
    ("issues", r"\bissues?\b|\bbugs?\b|\btickets?\b|\bsprint\b|\bjira\b"),
    ("spaces", r"\bconfluence\b|\bspaces?\b|\bwiki\b"),
    ("sheet", r"\b(rows?|columns?|sheet|average|sum|total|maximum|minimum)\b"),
    ("capability", r"\bcapabilit|\brag\b|\bagents?\b|\bcaching\b"),
    ("inventory", r"\bhow many\b|\bnumber of\b|\bcount of\b"),
]


def route_fact_question(text: Column) -> Column:
    """First pattern of the ladder the question fits, else null."""
    low = F.lower(text)
    out = None
    for name, p in LADDER:
        out = F.when(low.rlike(p), name) if out is None else out.when(low.rlike(p), name)
    return out


def grouped_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension and in total, one pass: (dimension, bucket, n)."""
    m = len(dims)
    g = df.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    full = (1 << m) - 1
    dim = F.when(F.col("_g") == full, "total")
    bucket = F.when(F.col("_g") == full, "")
    for i, d in enumerate(dims):
        hit = F.col("_g") == full - (1 << (m - 1 - i))
        dim, bucket = dim.when(hit, d), bucket.when(hit, F.coalesce(F.col(d).cast("string"), F.lit("")))
    return g.select(dim.alias("dimension"), bucket.alias("bucket"), "n")


def document_counts(documents: DataFrame) -> DataFrame:
    """Total, by area (source, else uri scheme) and by type."""
    area = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.regexp_extract("uri", "^([a-z]+)://", 1))
    return grouped_counts(documents.select(area.alias("area"), F.col("type")), ["area", "type"])


def project_counts(issues: DataFrame) -> DataFrame:
    """Issue counts per project by status, priority, type and assignee: (project, dimension, bucket, n)."""
    dims = ["status", "priority", "type", "assignee"]
    x = issues.select("project", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit("")).alias("bucket")) for d in dims], F.struct(F.lit("total").alias("dimension"), F.lit("").alias("bucket")))).alias("x"))
    return x.groupBy("project", "x.dimension", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def current_sprint(issues: DataFrame) -> DataFrame:
    """Most common active sprint per project, else the most common one; ties to the smaller name."""
    s = issues.where("sprint is not null").select("project", F.col("sprint.name").alias("name"), (F.col("sprint.state") == "active").alias("active"))
    c = s.groupBy("project", "name", "active").agg(F.count(F.lit(1)).alias("n"))
    a = c.where("active").withColumn("tier", F.lit(1))
    b = c.groupBy("project", "name").agg(F.sum("n").alias("n"), F.bool_or("active").alias("active")).withColumn("tier", F.lit(0))
    u = a.unionByName(b)
    first = top_k(u, ["project"], [F.desc("tier"), F.desc("n"), F.col("name")], 1, "_r")
    return first.select("project", "name", (F.col("tier") == 1).alias("active"), "n")


def column_counts(columns: DataFrame, status_counts: DataFrame) -> DataFrame:
    """Issues per board column: the sum over the column's statuses. columns (board, project, column, statuses)."""
    c = columns.select("board", "project", "column", F.explode_outer("statuses").alias("status")).join(status_counts, ["project", "status"], "left")
    return c.groupBy("board", "column").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def _whole(text: Column, value: Column) -> Column:
    esc = F.regexp_replace(value, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), esc, F.lit("(?![a-z0-9])")))


def named_value(questions: DataFrame, values: DataFrame) -> DataFrame:
    """Longest breakdown value a question names: (query_id, dimension, value, n).

    ``values``: (dimension, bucket, n). Questions and values meet on the value's first token.
    """
    from ..functions.text import tokens

    v = values.select("dimension", F.lower(F.trim("bucket")).alias("value"), "n").where("value not in ('', 'open')")
    v = v.withColumn("t", F.try_element_at(tokens("value"), F.lit(1))).where("t is not null")
    q = questions.select("query_id", F.lower("text").alias("_q"), F.explode(F.array_distinct(tokens("text"))).alias("t"))
    hit = q.join(v, "t").where(_whole(F.col("_q"), F.col("value")))
    order = [F.desc(F.length("value")), F.col("dimension"), F.col("value")]
    return top_k(hit.select("query_id", "dimension", "value", "n").distinct(), ["query_id"], order, 1, "_r").drop("_r")


def open_issues(issues: DataFrame) -> DataFrame:
    """Open (not done-like) issues and open bugs per project."""
    is_open = ~F.lower("status").isin(*DONE_LIKE)
    return issues.groupBy("project").agg(F.count_if(is_open).alias("open"), F.count_if(is_open & (F.lower("type") == "bug")).alias("open_bugs"), F.count(F.lit(1)).alias("total"))


AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


def sheet_aggregate(sheet: DataFrame, agg: str, column: str | None, by: str | None = None, places: int = 2) -> DataFrame:
    """count, sum, avg, max or min of a column, optionally grouped, largest first."""
    a = AGGREGATES[agg](F.col(column) if column else None)
    a = F.round(a, places) if agg in ("sum", "avg") else a
    g = sheet.groupBy(*([by] if by else [])).agg(a.alias("value"))
    return g.orderBy(F.desc("value"), by) if by else g


def top_people(rows: DataFrame, key: str, person: str, weight: str, k: int) -> DataFrame:
    """Top ``k`` people per key: contributors by commits, assignees by issues."""
    g = rows.groupBy(key, person).agg(F.sum(weight).alias("n"))
    return top_k(g, [key], [F.desc("n"), F.col(person)], k)


def licence_inventory(deps: DataFrame, family: str | None = None, names: int = 8) -> DataFrame:
    """Dependencies per licence with the first names: (licence, category, n, names)."""
    d = deps if family is None else deps.where(F.col("category") == family)
    one = d.groupBy("licence", "category", "name").agg(F.count(F.lit(1)).alias("c"))
    n = one.groupBy("licence", "category").agg(F.sum("c").alias("n"))
    top = top_k(one, ["licence", "category"], [F.col("name")], names, "_r").groupBy("licence", "category").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return n.join(top, ["licence", "category"])


def capability_count(caps: DataFrame, repos: DataFrame, floor: float = 0.5) -> DataFrame:
    """Repositories with each capability at enough confidence over all repositories."""
    total = repos.agg(F.count_distinct("repo").alias("repos"))
    g = caps.where(F.col("confidence") >= floor).groupBy("capability").agg(F.count_distinct("repo").alias("n"), F.max_by("repo", F.struct("confidence", "repo")).alias("best"))
    return g.join(total, F.lit(True))


def reusable(caps: DataFrame) -> DataFrame:
    """Reusable components per capability: explode of the attribute list."""
    return caps.select("repo", "capability", F.explode("reusable").alias("r")).select("repo", "capability", "r.*")


def style_files(files: DataFrame) -> DataFrame:
    s = files.where(F.col("path").rlike(r"(?i)\.(css|scss)$"))
    return s.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("repo").alias("repos"))


def readiness(rows: DataFrame) -> DataFrame:
    """Percent and verdict: a fraction or percent score, else the checklist ratio.

    ``rows``: (repo, score double or null, checklist array<struct<item, present>>).
    """
    n = F.size("checklist")
    have = F.size(F.filter("checklist", lambda c: c["present"]))
    s = F.col("score")
    pct = F.when(s.isNull(), F.when(n > 0, F.round(100.0 * have / n)).otherwise(0.0)).when((s >= 0) & (s <= 1), F.round(s * 100)).otherwise(F.round(s))
    return rows.select("repo", pct.cast("int").alias("pct"), F.when(pct >= 70, "largely ready").when(pct >= 40, "partly ready").otherwise("not yet ready").alias("verdict"), have.alias("present"), n.alias("items"))


def techniques(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Techniques per repository from attributes, else found in the text, with the first two paragraphs."""
    from ..functions.text import paragraphs

    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.contains(v), v) for v in vocabulary]))
    t = F.when(F.size(F.coalesce("attributes", F.array().cast("array<string>"))) > 0, F.col("attributes")).otherwise(found)
    return rows.select("repo", F.array_sort(t).alias("techniques"), F.array_join(F.slice(paragraphs(F.coalesce("text", F.lit(""))), 1, 2), "\n\n").alias("summary"))


def metric_focus(questions: DataFrame, facts: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Values of the repositories and metrics a question names: (query_id, repo, metric, value).

    ``metrics`` maps a facts column to the pattern that asks for it. Repositories are met by their
    name tokens and verified as whole words.
    """
    from ..functions.text import tokens

    wide = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    f = facts.select("repo", F.explode(wide).alias("x")).select("repo", "x.*")
    asked = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), m) for m, p in metrics.items()]))
    q = questions.select("query_id", F.lower("text").alias("_q"), asked.alias("_m"), F.explode(F.array_distinct(tokens("text"))).alias("t"))
    r = facts.select("repo", F.try_element_at(tokens("repo"), F.lit(1)).alias("t"))
    hit = q.join(r, "t").where(_whole(F.col("_q"), F.lower("repo"))).select("query_id", "repo", F.explode("_m").alias("metric")).distinct()
    return hit.join(f, ["repo", "metric"])


def source_counts(facts: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """One row per source with its totals: {source: (table, aggregates)}; union of small rows."""
    out = None
    for name, (df, aggs) in facts.items():
        row = df.agg(*aggs).select(F.lit(name).alias("source"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def recent_activity(docs: DataFrame, k: int = 10) -> DataFrame:
    """Last ``k`` pull requests and commits per repository from document uris."""
    kind = F.when(F.col("uri").contains("/pulls/"), "pull_request").when(F.col("uri").contains("/commits/"), "commit")
    d = docs.withColumn("kind", kind).where("kind is not null").withColumn("repo", F.regexp_extract("uri", "^github://([^/]+/[^/]+)/", 1))
    return top_k(d.select("repo", "kind", "uri", "at"), ["repo", "kind"], [F.desc("at"), F.col("uri")], k)


def capability_insights(caps: DataFrame, reuse: DataFrame, k: int = 5) -> DataFrame:
    """Capability to its best repositories, with reuse candidates or the best repository as fallback."""
    top = top_k(caps, ["capability"], [F.desc("confidence"), F.col("repo")], k)
    g = top.groupBy("capability").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "repo"))), lambda x: x["repo"]).alias("repos"))
    r = reuse.groupBy("capability").agg(F.min("component").alias("candidate"))
    return g.join(r, "capability", "left").select("capability", "repos", F.coalesce("candidate", F.col("repos")[0].cast("string")).alias("candidate"))


def repository_overview(repos: DataFrame, capabilities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Facts joined with capability and dependency counts by repository."""
    c = capabilities.groupBy("repo").agg(F.count_distinct("capability").alias("capabilities"))
    d = dependencies.groupBy("repo").agg(F.count(F.lit(1)).alias("dependencies"))
    return repos.join(c, "repo", "left").join(d, "repo", "left").fillna(0, ["capabilities", "dependencies"])
