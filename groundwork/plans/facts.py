"""Exact fact queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as A
from ..registry import query
from ..session import table, wide_table
from ..sources import records as R
from .conversion import question_log
from .records import raw_issues, repo_snapshot


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Flat issues of five projects from the orders."""
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    sp = F.when(F.col("o_custkey") % 4 != 0, F.struct(F.concat(F.lit("S"), F.year("o_orderdate").cast("string")).alias("name"), F.when((st == "P") & (F.col("o_custkey") % 5 != 2), "active").otherwise("closed").alias("state")))
    return o.select(
        F.concat(F.lit("P"), (F.col("o_custkey") % 5).cast("string")).alias("project"), F.when(st == "F", "Done").when(st == "O", "Open").otherwise("In Progress").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_custkey") % 3 == 0, "Bug").otherwise("Task").alias("type"), F.concat(F.lit("user"), (F.col("o_custkey") % 50).cast("string")).alias("assignee"), sp.alias("sprint"),
    )


_IS = """i AS (SELECT 'P' || (o_custkey % 5) AS project, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' ELSE 'In Progress' END AS status, o_orderpriority AS priority, CASE WHEN o_custkey % 3 = 0 THEN 'Bug' ELSE 'Task' END AS type, 'user' || (o_custkey % 50) AS assignee,
 CASE WHEN o_custkey % 4 <> 0 THEN 'S' || year(o_orderdate) END AS sprint, o_orderstatus = 'P' AND o_custkey % 5 <> 2 AS active FROM orders)"""


@query("document_counts", "A1 A17", """
SELECT 'total' AS dimension, '' AS bucket, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'area', CASE WHEN lang = 'de' THEN 'doc' ELSE source END, count(*)::BIGINT FROM documents GROUP BY 2 UNION ALL SELECT 'type', lang, count(*)::BIGINT FROM documents GROUP BY 2
""")
def document_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("source"), F.lit("doc://x").alias("uri"), F.col("lang").alias("type"))
    return A.document_counts(d)


@query("project_counts", "A2", f"WITH {_IS} " + " UNION ALL ".join(f"SELECT project, '{d}' AS dimension, {d} AS bucket, count(*)::BIGINT AS n FROM i GROUP BY ALL" for d in ("status", "priority", "type", "assignee")) + " UNION ALL SELECT project, 'total', '', count(*)::BIGINT FROM i GROUP BY project")
def project_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.project_counts(issues(spark, sf))


@query("current_sprint", "A2 A5", f"""
WITH {_IS}, a AS (SELECT project, sprint AS name, TRUE AS active, count(*) AS n FROM i WHERE sprint IS NOT NULL AND active GROUP BY ALL), b AS (SELECT project, sprint AS name, FALSE AS active, count(*) AS n FROM i WHERE sprint IS NOT NULL GROUP BY ALL), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT project, name, active, n::BIGINT AS n FROM u QUALIFY row_number() OVER (PARTITION BY project ORDER BY active DESC, n DESC, name) = 1
""")
def current_sprint(spark: SparkSession, sf: str) -> DataFrame:
    return A.current_sprint(issues(spark, sf))


@query("open_issues", "A5 A20", f"WITH {_IS} SELECT project, (count(*) FILTER (status <> 'Done'))::BIGINT AS open, (count(*) FILTER (status <> 'Done' AND type = 'Bug'))::BIGINT AS open_bugs, count(*)::BIGINT AS total FROM i GROUP BY 1")
def open_issues(spark: SparkSession, sf: str) -> DataFrame:
    return A.open_issues(issues(spark, sf))


@query("board_columns", "A3", f"""
WITH {_IS}, s AS (SELECT project, status, count(*) AS n FROM i GROUP BY ALL), c AS (SELECT DISTINCT project, unnest(['Todo', 'Doing', 'Closed', 'Parked']) AS col FROM i)
SELECT 'b' || c.project AS board, col AS column, coalesce(sum(s.n), 0)::BIGINT AS n FROM c LEFT JOIN s ON s.project = c.project AND ((col = 'Todo' AND status = 'Open') OR (col = 'Doing' AND status IN ('In Progress', 'Open')) OR (col = 'Closed' AND status = 'Done')) GROUP BY ALL
""")
def board_columns(spark: SparkSession, sf: str) -> DataFrame:
    i = issues(spark, sf)
    cols = F.array(*[F.struct(F.lit(n).alias("column"), F.array(*[F.lit(x) for x in st]).alias("statuses")) for n, st in (("Todo", ["Open"]), ("Doing", ["In Progress", "Open"]), ("Closed", ["Done"]), ("Parked", ["Frozen"]))])
    b = i.select("project").distinct().select(F.concat(F.lit("b"), "project").alias("board"), "project", F.explode(cols).alias("c")).select("board", "project", "c.*")
    return A.column_counts(b, i.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n")))


@query("named_value", "A4", f"""
WITH {_IS}, v AS (SELECT 'status' AS dimension, lower(status) AS value, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT 'type', lower(type), count(*) FROM i GROUP BY ALL UNION ALL SELECT 'assignee', lower(assignee), count(*) FROM i GROUP BY ALL UNION ALL SELECT 'priority', lower(priority), count(*) FROM i GROUP BY ALL),
q AS (SELECT c_custkey AS query_id, 'how many ' || CASE c_nationkey % 4 WHEN 0 THEN 'bug issues in progress' WHEN 1 THEN 'items of user' || (c_custkey % 60) WHEN 2 THEN '3-medium tasks' ELSE 'open things' END || ' are there' AS t FROM customer)
SELECT query_id, dimension, value, n::BIGINT AS n FROM q JOIN v ON value <> 'open' AND regexp_matches(t, '(^|[^a-z0-9])' || value || '($|[^a-z0-9])') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(value) DESC, dimension, value) = 1
""")
def named_value(spark: SparkSession, sf: str) -> DataFrame:
    v = A.project_counts(issues(spark, sf)).where("dimension <> 'total'").groupBy("dimension", "bucket").agg(F.sum("n").alias("n"))
    k = F.col("c_nationkey") % 4
    body = F.when(k == 0, "bug issues in progress").when(k == 1, F.concat(F.lit("items of user"), (F.col("c_custkey") % 60).cast("string"))).when(k == 2, "3-medium tasks").otherwise("open things")
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("how many "), body, F.lit(" are there")).alias("text"))
    return A.named_value(q, v)


@query("sheet_aggregate", "A6", """
SELECT o_orderpriority, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1
""")
def sheet_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return A.sheet_aggregate(table(spark, sf, "orders"), "avg", "o_totalprice", "o_orderpriority", places=6)


@query("who_questions", "A8", """
WITH c AS (SELECT l_suppkey AS repo, p_brand AS login, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT repo, login, n::BIGINT AS n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, login)::INTEGER AS rank FROM c QUALIFY rank <= 5
""")
def who_questions(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_people(repo_snapshot(spark, sf)["contributors"], "repo", "login", "contributions", 5)


@query("language_bar", "A22", """
WITH l AS (SELECT l_suppkey AS repo, p_type AS language, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT repo, language, bytes, round(bytes / sum(bytes) OVER (PARTITION BY repo)::DOUBLE, 4) AS share FROM l
""")
def language_bar(spark: SparkSession, sf: str) -> DataFrame:
    return R.language_shares(repo_snapshot(spark, sf)["languages"])


LICENCES = ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "PolyForm-Noncommercial", "Mozilla Public License", "custom", "unknown", "CC-BY-NC-4.0", "ISC"]


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts a supplier ships as its dependencies, the licence by part size."""
    from ..operators.codejobs import licence_category

    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    d = li.select("l_suppkey", "l_partkey").distinct().join(p, F.col("l_partkey") == F.col("p_partkey"))
    lic = F.element_at(F.array(*[F.lit(x) for x in LICENCES]), (F.col("p_size") % len(LICENCES) + 1).cast("int"))
    return d.select(F.col("l_suppkey").alias("repo"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.lower("p_type").alias("ecosystem"), lic.alias("licence")).withColumn("category", licence_category(F.col("licence")))


_DEPS = f"""d AS (SELECT DISTINCT l_suppkey AS repo, p_name || '-' || p_partkey AS name, lower(p_type) AS ecosystem, ({'[' + ','.join(f"'{x}'" for x in LICENCES) + ']'})[p_size % {len(LICENCES)} + 1] AS licence FROM lineitem JOIN part ON p_partkey = l_partkey),
dc AS (SELECT *, CASE WHEN licence IN ('PolyForm-Noncommercial', 'CC-BY-NC-4.0') THEN 'non_commercial' WHEN licence IN ('GPL-3.0', 'Mozilla Public License') THEN 'copyleft' WHEN licence IN ('MIT', 'Apache-2.0', 'BSD-3-Clause', 'ISC') THEN 'permissive' ELSE 'unknown' END AS category FROM d)"""


@query("licence_inventory", "A9 K4", f"""
WITH {_DEPS}, o AS (SELECT licence, category, name, count(*) AS c FROM dc GROUP BY ALL) SELECT licence, category, sum(c)::BIGINT AS n, array_to_string(list(name ORDER BY name)[1:8], ',') AS names FROM o GROUP BY ALL
""")
def licence_inventory(spark: SparkSession, sf: str) -> DataFrame:
    d = A.licence_inventory(dependencies(spark, sf))
    return d.withColumn("names", F.array_join("names", ","))


@query("dependency_summary", "K5", f"""
WITH {_DEPS} SELECT repo, 'category' AS dimension, category AS bucket, count(*)::BIGINT AS n FROM dc GROUP BY ALL UNION ALL SELECT repo, 'ecosystem', ecosystem, count(*)::BIGINT FROM dc GROUP BY ALL
""")
def dependency_summary(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.codejobs import dependency_summary as summary

    return summary(dependencies(spark, sf))


def capability_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's part types as capabilities; confidence grows with the lines shipped."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("repo"), F.lower("p_type").alias("capability")).agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("component"))
    return g.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 50.0), 4))


_CAP = "cp AS (SELECT l_suppkey AS repo, lower(p_type) AS capability, count(*) AS n, min(p_name) AS component, round(least(1e0, count(*) / 5e1), 4) AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' GROUP BY ALL)"


@query("capability_count", "A10", f"""
WITH {_CAP} SELECT capability, count(DISTINCT repo)::BIGINT AS n, arg_max(repo, (confidence, repo)) AS best, (SELECT count(*) FROM supplier)::BIGINT AS repos FROM cp WHERE confidence >= 5e-1 GROUP BY 1
""")
def capability_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.capability_count(capability_rows(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo")))


@query("capability_insights", "A24 A11", f"""
WITH {_CAP}, t AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY confidence DESC, repo) AS r FROM cp), g AS (SELECT capability, string_agg(repo::VARCHAR, ',' ORDER BY r) AS repos FROM t WHERE r <= 5 GROUP BY 1), u AS (SELECT capability, min(component) AS c FROM cp WHERE n > 60 GROUP BY 1)
SELECT capability, repos, coalesce(c, split_part(repos, ',', 1)) AS candidate FROM g LEFT JOIN u USING (capability)
""")
def capability_insights(spark: SparkSession, sf: str) -> DataFrame:
    c = capability_rows(spark, sf).withColumn("repo", F.col("repo").cast("string"))
    top = c.select(F.col("repo").cast("long").alias("repo"), "capability", "confidence")
    r = A.reusable(c.where("n > 60").select("repo", "capability", F.array(F.struct("component")).alias("reusable")))
    i = A.capability_insights(top, r.select("capability", "component"))
    return i.select("capability", F.array_join(F.transform("repos", lambda x: x.cast("string")), ",").alias("repos"), "candidate")


@query("reusable_components", "A11", f"WITH {_CAP} SELECT repo, capability, component FROM cp WHERE n > 20")
def reusable_components(spark: SparkSession, sf: str) -> DataFrame:
    c = capability_rows(spark, sf).where("n > 20")
    return A.reusable(c.select("repo", "capability", F.array(F.struct("component")).alias("reusable")))


@query("style_files", "A12", """
SELECT count(*)::BIGINT AS files, count(DISTINCT l_suppkey)::BIGINT AS repos FROM lineitem WHERE l_partkey % 9 = 4
""")
def style_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo"), F.when(F.col("l_partkey") % 9 == 4, "a/x.scss").otherwise("b/y.py").alias("path"))
    return A.style_files(f)


@query("readiness_verdict", "A13", """
WITH r AS (SELECT s_suppkey AS repo, CASE WHEN s_nationkey % 3 = 0 THEN s_nationkey / 25e0 WHEN s_nationkey % 3 = 1 THEN s_nationkey * 4e0 END AS score, (s_acctbal > 0)::INTEGER + (s_acctbal > 3000)::INTEGER + (s_acctbal > 6000)::INTEGER + (s_nationkey > 12)::INTEGER AS present FROM supplier),
p AS (SELECT repo, present, CASE WHEN score IS NULL THEN round(1e2 * present / 4) WHEN score BETWEEN 0 AND 1 THEN round(score * 100) ELSE round(score) END AS pct FROM r)
SELECT repo, pct::INTEGER AS pct, CASE WHEN pct >= 70 THEN 'largely ready' WHEN pct >= 40 THEN 'partly ready' ELSE 'not yet ready' END AS verdict, present::INTEGER AS present, 4::INTEGER AS items FROM p
""")
def readiness_verdict(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    n = F.col("s_nationkey")
    item = lambda i, c: F.struct(F.lit(i).alias("item"), c.alias("present"))
    r = s.select(F.col("s_suppkey").alias("repo"), F.when(n % 3 == 0, n / 25.0).when(n % 3 == 1, n * 4.0).alias("score"), F.array(item("a", F.col("s_acctbal") > 0), item("b", F.col("s_acctbal") > 3000), item("c", F.col("s_acctbal") > 6000), item("d", n > 12)).alias("checklist"))
    return A.readiness(r)


@query("techniques", "A14", r"""
SELECT doc_id AS repo, array_to_string(list_filter([CASE WHEN contains(lower(text), 'ering') THEN 'ering' END, CASE WHEN contains(lower(text), 'ment') THEN 'ment' END, CASE WHEN contains(lower(text), 'tion') THEN 'tion' END], lambda x: x IS NOT NULL), ',') AS techniques, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS summary_md5 FROM documents
""")
def techniques(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_table(spark, sf, "documents").select(F.col("doc_id").alias("repo"), F.lit(None).cast("array<string>").alias("attributes"), "text")
    t = A.techniques(d, ["ering", "ment", "tion"])
    return t.select("repo", F.array_join("techniques", ",").alias("techniques"), F.md5("summary").alias("summary_md5"))


@query("fact_routing", "A18", """
WITH q AS (SELECT conv_id, turn, (['How many items in ','Compare with the other ','Which kinds of ','hello ','Is there any example of ','verify the commit for ',''])[(conv_id + turn) % 7 + 1] || text AS t FROM conversations), l AS (SELECT conv_id, turn, lower(t) AS l FROM q)
SELECT conv_id, turn, CASE WHEN regexp_matches(l, '\\b(example|examples|implementation|implementations)\\s+of\\b') THEN 'examples' WHEN regexp_matches(l, '\\breusable\\b|\\breuse\\b|\\bre-usable\\b') THEN 'reusable' WHEN regexp_matches(l, '\\bcss\\b|\\bstylesheets?\\b|\\bstyle sheets?\\b') THEN 'css' WHEN regexp_matches(l, 'licen[cs]e|dependenc|librar|packages?\\b|third[- ]party') THEN 'licences'
 WHEN regexp_matches(l, 'enterprise|production[- ]?ready|production[- ]grade|scalable|ready for production|scal(e|ability)') THEN 'enterprise' WHEN regexp_matches(l, '\\barchitecture\\b|\\bdesigned\\b|\\btechniques?\\b') THEN 'architecture' WHEN regexp_matches(l, '\\bwho\\b|\\bcontributors?\\b|\\bassignees?\\b') THEN 'who' WHEN regexp_matches(l, '\\bcommits?\\b|\\bpull requests?\\b|\\bprs?\\b|\\breleases?\\b|\\bdeploy|\\bworkflows?\\b|\\blanguages?\\b') THEN 'repo'
 WHEN regexp_matches(l, '\\bissues?\\b|\\bbugs?\\b|\\btickets?\\b|\\bsprint\\b|\\bjira\\b') THEN 'issues' WHEN regexp_matches(l, '\\bconfluence\\b|\\bspaces?\\b|\\bwiki\\b') THEN 'spaces' WHEN regexp_matches(l, '\\b(rows?|columns?|sheet|average|sum|total|maximum|minimum)\\b') THEN 'sheet' WHEN regexp_matches(l, '\\bcapabilit|\\brag\\b|\\bagents?\\b|\\bcaching\\b') THEN 'capability' WHEN regexp_matches(l, '\\bhow many\\b|\\bnumber of\\b|\\bcount of\\b') THEN 'inventory' END AS route FROM l
""")
def fact_routing(spark: SparkSession, sf: str) -> DataFrame:
    return question_log(spark, sf).select("conv_id", "turn", A.route_fact_question(F.col("question")).alias("route"))


@query("metric_focus", "A19", """
WITH f AS (SELECT s_name AS repo, count(*) AS commits, sum(l_quantity) AS changes FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1), q AS (SELECT s_suppkey AS query_id, s_name AS repo, s_nationkey % 2 = 0 AS both FROM supplier)
SELECT query_id, repo, 'commits' AS metric, commits::DOUBLE AS value FROM q JOIN f USING (repo) UNION ALL SELECT query_id, repo, 'changes', changes::DOUBLE FROM q JOIN f USING (repo) WHERE "both"
""".replace("AS both", 'AS "both"'))
def metric_focus(spark: SparkSession, sf: str) -> DataFrame:
    s, li = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    f = s.join(li, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_name").alias("repo")).agg(F.count(F.lit(1)).alias("commits"), F.sum("l_quantity").alias("changes"))
    # names share the word before the number, so the number leads in the tables that are matched
    flip = lambda c: F.concat_ws(" ", F.element_at(F.split(c, "#"), 2), F.element_at(F.split(c, "#"), 1))
    q = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("how many commits"), F.when(F.col("s_nationkey") % 2 == 0, " and changes").otherwise(""), F.lit(" in "), flip(F.col("s_name"))).alias("text"))
    hit = A.metric_focus(q, f.withColumn("repo", flip(F.col("repo"))), {"commits": r"\bcommits?\b", "changes": r"\bchanges?\b"})
    return hit.select("query_id", F.concat_ws("#", F.element_at(F.split("repo", " "), 2), F.element_at(F.split("repo", " "), 1)).alias("repo"), "metric", "value")


@query("source_counts", "A20 A21", """
SELECT 'documents' AS source, count(*)::BIGINT AS items, NULL::BIGINT AS total FROM documents UNION ALL SELECT 'orders', count(*)::BIGINT, sum(o_custkey)::BIGINT FROM orders UNION ALL SELECT 'suppliers', count(*)::BIGINT, NULL FROM supplier
""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1)).alias("items")
    c = A.source_counts({"documents": (table(spark, sf, "documents"), [n]), "orders": (table(spark, sf, "orders"), [n, F.sum("o_custkey").alias("total")]), "suppliers": (table(spark, sf, "supplier"), [n])})
    return c.select("source", "items", "total")


@query("recent_activity", "A23", """
WITH d AS (SELECT 'o/' || o_custkey AS repo, CASE WHEN o_orderstatus = 'F' THEN 'pull_request' ELSE 'commit' END AS kind, 'github://o/' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN '/pulls/' ELSE '/commits/' END || o_orderkey AS uri, epoch_us(o_orderdate) // 1000 AS at_ FROM orders WHERE o_orderstatus <> 'P')
SELECT repo, kind, uri, at_ AS "at", row_number() OVER (PARTITION BY repo, kind ORDER BY at_ DESC, uri)::INTEGER AS rank FROM d QUALIFY rank <= 3
""")
def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    uri = F.concat(F.lit("github://o/"), F.col("o_custkey").cast("string"), F.when(st == "F", "/pulls/").when(st == "O", "/commits/").otherwise("/blob/"), F.col("o_orderkey").cast("string"))
    return A.recent_activity(o.select(uri.alias("uri"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at")), 3)


@query("repository_overview", "J16 A7", f"""
WITH {_DEPS}, {_CAP} SELECT s_suppkey AS repo, (SELECT count(DISTINCT capability) FROM cp WHERE cp.repo = s_suppkey)::BIGINT AS capabilities, (SELECT count(*) FROM d WHERE d.repo = s_suppkey)::BIGINT AS dependencies FROM supplier
""")
def repository_overview(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo"))
    return A.repository_overview(r, capability_rows(spark, sf), dependencies(spark, sf))


@query("issue_project_rollup", "A2 S8", """
WITH i AS (SELECT 'P' || (o_custkey % 5) AS project, o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_custkey % 3 = 0 THEN 'Bug' ELSE 'Task' END AS type, CASE WHEN o_orderstatus = 'P' THEN 'Unassigned' ELSE 'user' || o_custkey END AS assignee FROM orders)
""" + " UNION ALL ".join(f"SELECT project, '{d}' AS dimension, {d} AS bucket, count(*)::BIGINT AS n FROM i GROUP BY ALL" for d in ("status", "priority", "type", "assignee")) + " UNION ALL SELECT project, 'total', '', count(*)::BIGINT FROM i GROUP BY project")
def issue_project_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts straight from the nested issue JSON."""
    return A.project_counts(R.flatten_issues(raw_issues(spark, sf), "https://t.example"))

