"""Source queries: issue, code, wiki and web records over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import table, wide_table
from ..sources import files as S
from ..sources import records as R

_PATHS = ["src/a.py", "tests/x.py", "a/test_b.py", "lib/c_test.py", "ui/d.spec.ts", "docs/progress/e.md", "docs/f.md", "pkg/.github/w.yml", "conftest.py", "spec/g.rb", "README.md", "img/h.PNG", "node_modules/i.js", "requirements-dev.txt"]


def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as repository files."""
    li = table(spark, sf, "lineitem")
    p = F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (F.col("l_partkey") % len(_PATHS) + 1).cast("int"))
    return li.select(F.concat(F.lit("d"), F.col("l_suppkey").cast("string"), F.lit("/"), p).alias("path"), (F.col("l_extendedprice") * 8).cast("long").alias("length"))




@query("excluded_paths", "S7", f"""
WITH rf AS (SELECT 'd' || l_suppkey || '/' || ({'[' + ','.join(f"'{x}'" for x in _PATHS) + ']'})[l_partkey % {len(_PATHS)} + 1] AS path FROM lineitem)
SELECT path, count(*)::BIGINT AS n, regexp_matches(path, '(^|/)(test_[^/]+\\.py|[^/]+_test\\.py|[^/]+\\.spec\\.[^/]+|conftest\\.py)$') OR len(list_intersect(string_split(path, '/'), ['tests','test','__tests__','spec','.github'])) > 0 OR contains('/' || path || '/', '/docs/progress/') AS excluded FROM rf GROUP BY path
""")
def excluded_paths(spark: SparkSession, sf: str) -> DataFrame:
    return repo_files(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", "n", R.excluded_path(F.col("path")).alias("excluded"))


@query("repository_files", "S12", f"""
WITH rf AS (SELECT 'd' || l_suppkey || '/' || ({'[' + ','.join(f"'{x}'" for x in _PATHS) + ']'})[l_partkey % {len(_PATHS)} + 1] AS path, floor(l_extendedprice * 8)::BIGINT AS length FROM lineitem),
k AS (SELECT *, CASE WHEN regexp_matches(path, '(?i)\\.(png|svg)$') THEN 'image' WHEN regexp_matches(path, '\\.(py|js|ts|rb)$') THEN 'code' WHEN regexp_matches(path, '\\.(md|txt)$') THEN 'doc' WHEN regexp_matches(path, '\\.(yml|json)$') THEN 'config' END AS kind FROM rf WHERE path NOT LIKE '%node_modules/%')
SELECT kind, CASE WHEN kind = 'doc' THEN 'Architecture' ELSE 'Code' END AS area, count(*)::BIGINT AS files, sum(length)::BIGINT AS bytes FROM k WHERE kind IS NOT NULL AND length > 0 AND length <= CASE WHEN kind = 'image' THEN 5000000 ELSE 512000 END GROUP BY ALL
""")
def repository_files(spark: SparkSession, sf: str) -> DataFrame:
    f = S.repository_files(repo_files(spark, sf), "acme/shop", "main")
    return f.groupBy("kind", "area").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("repository_skips", "S12", f"""
WITH rf AS (SELECT 'd' || l_suppkey || '/' || ({'[' + ','.join(f"'{x}'" for x in _PATHS) + ']'})[l_partkey % {len(_PATHS)} + 1] AS path, floor(l_extendedprice * 8)::BIGINT AS length FROM lineitem),
k AS (SELECT *, CASE WHEN regexp_matches(path, '(?i)\\.(png|svg)$') THEN 5000000 WHEN regexp_matches(path, '\\.(py|js|ts|rb|md|txt|yml|json)$') THEN 512000 END AS cap FROM rf),
r AS (SELECT length, CASE WHEN path LIKE '%node_modules/%' THEN 'folder' WHEN cap IS NULL THEN 'kind' WHEN length <= 0 THEN 'empty' WHEN length > cap THEN 'oversize' END AS reason FROM k)
SELECT reason, count(*)::BIGINT AS files, sum(length)::BIGINT AS bytes FROM r WHERE reason IS NOT NULL GROUP BY reason
""")
def repository_skips(spark: SparkSession, sf: str) -> DataFrame:
    return S.skipped_files(repo_files(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("issue_flatten", "S8 S9 S5", """
SELECT 'ORD-' || o_orderkey AS key, 'P' || (o_custkey % 5) AS project, 'Order ' || o_orderkey AS summary, 'Para one' || e'\\n\\n' || 'state ' || o_orderstatus AS description, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 'Unassigned' ELSE 'user' || o_custkey END AS assignee, o_orderpriority AS priority,
 CASE WHEN o_orderstatus = 'F' THEN 'S2' ELSE 'S1' END AS sprint, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS comments, CASE WHEN o_orderstatus = 'O' THEN 'is blocked by ORD-' || (o_orderkey + 1) ELSE 'blocks ORD-' || (o_orderkey + 1) END AS link, 'https://t.example/browse/ORD-' || o_orderkey AS url FROM orders
""")
def issue_flatten(spark: SparkSession, sf: str) -> DataFrame:
    f = R.flatten_issues(raw_issues(spark, sf), "https://t.example")
    return f.select("key", "project", "summary", "description", "status", "assignee", "priority", F.col("sprint.name").alias("sprint"), F.size("comments").alias("comments"), F.concat_ws(" ", F.col("links")[0]["direction"], F.col("links")[0]["key"]).alias("link"), "url")


def raw_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nested issue JSON with rich-text descriptions."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    st = F.col("o_orderstatus")
    text = lambda t: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))
    desc = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(text(F.lit("Para one")), text(F.concat(F.lit("state "), st))).alias("content")))
    other = F.struct(F.concat(F.lit("ORD-"), (F.col("o_orderkey") + 1).cast("string")).alias("key"), F.struct(F.lit("next").alias("summary")).alias("fields"))
    link = F.struct(F.struct(F.lit("Blocks").alias("name"), F.lit("blocks").alias("outward"), F.lit("is blocked by").alias("inward")).alias("type"), F.when(st != "O", other).alias("outwardIssue"), F.when(st == "O", other).alias("inwardIssue"))
    sprint = F.array(F.struct(F.lit("S1").alias("name"), F.lit("closed").alias("state")), F.struct(F.lit("S2").alias("name"), F.when(st == "F", "ACTIVE").otherwise("future").alias("state")))
    com = F.when(st != "O", F.struct(F.array(F.struct(F.lit("1").alias("id"), F.struct(F.lit("ann").alias("displayName")).alias("author"), F.lit("x").alias("created"), F.lit("hi").alias("body"))).alias("comments")))
    fields = F.struct(
        F.concat(F.lit("Order "), k).alias("summary"), desc.alias("description"), F.struct(st.alias("name")).alias("status"), F.struct(F.when(st == "P", "").otherwise(F.concat(F.lit("user"), F.col("o_custkey").cast("string"))).alias("displayName")).alias("assignee"),
        F.struct(F.col("o_orderpriority").alias("name")).alias("priority"), F.struct(F.when(F.col("o_custkey") % 3 == 0, "Bug").otherwise("Task").alias("name")).alias("issuetype"), F.array(F.lit("x")).alias("labels"),
        F.struct(F.concat(F.lit("P"), (F.col("o_custkey") % 5).cast("string")).alias("key")).alias("project"), sprint.alias("sprint"), com.alias("comment"), F.array(link).alias("issuelinks"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"),
    )
    return o.select(F.to_json(F.struct(k.alias("id"), F.concat(F.lit("ORD-"), k).alias("key"), fields.alias("fields"))).alias("body"))


@query("record_delta", "S5 S6 S14 J8 T2", """
WITH r AS (SELECT o_orderpriority AS scope, epoch_us(o_orderdate) // 1000000 AS updated, o_orderstatus = 'P' AS deleted FROM orders), c AS (SELECT scope, min(updated) + 86400 * 700 AS cursor FROM r WHERE scope <> '2-HIGH' GROUP BY 1)
SELECT scope, deleted, count(*)::BIGINT AS n, max(updated)::BIGINT AS newest FROM r LEFT JOIN c USING (scope) WHERE scope <> '5-LOW' AND (cursor IS NULL OR updated > cursor) GROUP BY ALL
""")
def record_delta(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scope"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("updated"), (F.col("o_orderstatus") == "P").alias("deleted"))
    c = r.where("scope <> '2-HIGH'").groupBy("scope").agg((F.min("updated") + 86400 * 700).alias("cursor"))
    allow = r.select("scope").distinct().where("scope <> '5-LOW'")
    live, dead = R.pull_delta(r, allow, c, "scope")
    return live.unionByName(dead).groupBy("scope", "deleted").agg(F.count(F.lit(1)).alias("n"), F.max("updated").alias("newest"))


@query("changed_repositories", "S13", """
WITH c AS (SELECT o_custkey AS repo, max(epoch_us(o_orderdate)) AS p FROM orders GROUP BY 1), o AS (SELECT o_custkey AS repo, max(epoch_us(o_orderdate)) AS p FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT c.repo FROM c LEFT JOIN o ON o.repo = c.repo AND o.p = c.p WHERE o.repo IS NULL
""")
def changed_repositories(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    g = lambda d: d.groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderdate").alias("pushed_at"))
    return R.changed_scopes(g(o), g(o.where("o_orderstatus <> 'O'"))).select("repo")


def repo_snapshot(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Suppliers as repositories: part types are languages, parts contributors, lines pull requests."""
    li, p, o = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "orders")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    repo = F.col("l_suppkey").alias("repo")
    return {
        "languages": j.groupBy(repo, F.col("p_type").alias("language")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes")),
        "contributors": j.groupBy(repo, F.col("p_brand").alias("login")).agg(F.count(F.lit(1)).alias("contributions")),
        "pulls": li.select(repo, F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("state"), (F.col("l_returnflag") == "A").alias("merged"), F.col("l_quantity").cast("long").alias("additions"), F.lit(0).alias("deletions"), F.col("l_linenumber").cast("long").alias("changed_files")),
        "releases": j.where("o_orderstatus = 'F'").select(repo, F.col("o_orderkey").alias("tag"), F.col("o_orderdate").alias("published_at")),
        "deployments": j.select(repo, F.col("o_orderstatus").alias("environment"), F.col("o_orderkey").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at")),
    }


@query("repository_facts", "S10 A7 A22 J16", """
WITH j AS (SELECT l_suppkey AS repo, * FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
la AS (SELECT repo, p_type AS l, sum(l_quantity::BIGINT) AS b FROM j GROUP BY ALL), lg AS (SELECT repo, arg_max(l, (b, l)) AS primary_language, max(round(b / tot, 4)) AS top_share, count(*) AS languages FROM (SELECT *, sum(b) OVER (PARTITION BY repo)::DOUBLE AS tot FROM la) GROUP BY 1),
co AS (SELECT repo, count(*) AS contributors_count, arg_max(p_brand, (n, p_brand)) AS top_contributor FROM (SELECT repo, p_brand, count(*) AS n FROM j GROUP BY ALL) GROUP BY 1),
pr AS (SELECT l_suppkey AS repo, count(*) FILTER (l_returnflag <> 'A' AND l_linestatus = 'O') AS pr_open, count(*) FILTER (l_returnflag <> 'A' AND l_linestatus <> 'O') AS pr_closed, count(*) FILTER (l_returnflag = 'A') AS pr_merged, count(*) AS pr_total, round(avg(l_quantity::BIGINT) FILTER (l_returnflag = 'A')) AS ma, round(avg(l_linenumber) FILTER (l_returnflag = 'A')) AS mf FROM lineitem GROUP BY 1),
re AS (SELECT repo, count(*) AS releases, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_release FROM j WHERE o_orderstatus = 'F' GROUP BY 1), de AS (SELECT repo, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'P') AS dep FROM j GROUP BY 1)
SELECT repo, primary_language, top_share, languages::BIGINT AS languages, contributors_count::BIGINT AS contributors_count, top_contributor, pr_open::BIGINT AS pr_open, pr_closed::BIGINT AS pr_closed, pr_merged::BIGINT AS pr_merged, pr_total::BIGINT AS pr_total, coalesce(ma, 0)::BIGINT AS mean_additions, coalesce(mf, 0)::BIGINT AS mean_files,
 releases::BIGINT AS releases, latest_release, dep AS deployed_p FROM lg FULL JOIN co USING (repo) FULL JOIN pr USING (repo) FULL JOIN re USING (repo) FULL JOIN de USING (repo)
""")
def repository_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = R.repository_facts(**repo_snapshot(spark, sf))
    return f.withColumn("deployed_p", F.try_element_at("deployments", F.lit("P"))).drop("deployments")


@query("activity_passages", "S11", """
WITH c AS (SELECT o_custkey AS repo, o_orderkey AS sha, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR) AS r, o_orderstatus FROM orders),
p AS (SELECT l_suppkey AS repo, l_orderkey AS number, l_linenumber, l_returnflag, l_linestatus, l_quantity::BIGINT AS q FROM lineitem WHERE l_linenumber = 1)
SELECT 'c' || repo AS repo, CASE WHEN r <= 5 THEN 'github://c' || repo || '/commits/' || sha ELSE 'github://c' || repo || '/commits/history' END AS uri, (CASE WHEN r <= 5 THEN 0 ELSE r - 6 END)::BIGINT AS pos, 'commit' AS kind, 'Commit ' || substr(sha::VARCHAR, 1, 12) || ' by ann on ' || strftime(o_orderdate, '%Y-%m-%d') || ': set ' || o_orderstatus AS passage FROM c
UNION ALL SELECT 's' || repo, 'github://s' || repo || '/pulls/' || number, 0, 'pull_request', 'Pull request #' || number || ' (' || l_linestatus || ') by bob: change ' || number || '. Opened 2020' || CASE WHEN l_returnflag = 'A' THEN ', merged 2021' ELSE '' END || '. main ← dev; +' || q || '/−0 in 1 files.' FROM p
UNION ALL SELECT 's' || repo, 'github://s' || repo || '/pulls/' || number, 1, 'review', 'Review by cat (APPROVED): ok' FROM p WHERE l_returnflag = 'A'
UNION ALL SELECT 's' || repo, 'github://s' || repo || '/pulls/' || number, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END, 'files', 'Files changed: a.py, b.py' FROM p
""")
def activity_passages(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_linenumber = 1")
    commits = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo"), F.col("o_orderkey").cast("string").alias("sha"), F.lit("ann").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.concat(F.lit("set "), "o_orderstatus").alias("message"))
    review = F.when(F.col("l_returnflag") == "A", F.array(F.struct(F.lit("cat").alias("author"), F.lit("APPROVED").alias("state"), F.lit("ok").alias("body")))).otherwise(F.array().cast("array<struct<author:string,state:string,body:string>>"))
    pulls = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo"), F.col("l_orderkey").alias("number"), F.col("l_linestatus").alias("state"), F.lit("bob").alias("author"), F.concat(F.lit("change "), F.col("l_orderkey").cast("string")).alias("title"), F.lit("2020").alias("opened"),
        F.when(F.col("l_returnflag") == "A", "2021").alias("merged_at"), F.lit("main").alias("base"), F.lit("dev").alias("head"), F.col("l_quantity").cast("long").alias("additions"), F.lit(0).alias("deletions"), F.lit(1).alias("changed_files"), F.lit("").alias("body"), review.alias("reviews"), F.array(F.lit("a.py"), F.lit("b.py")).alias("files"),
    )
    return R.activity_passages(pulls, commits, 5)


@query("wiki_pages", "S14 A16", """
WITH p AS (SELECT 'sp' || (doc_id % 7) AS space, doc_id AS page_id, source AS title, n_chars AS created_at, md5(text) AS m FROM documents), c AS (SELECT space, (min(created_at) + 500) AS cursor FROM p WHERE space <> 'sp3' GROUP BY 1), f AS (SELECT p.* FROM p LEFT JOIN c USING (space) WHERE cursor IS NULL OR created_at > cursor)
SELECT f.space, count(*)::BIGINT AS new_pages, max(created_at)::BIGINT AS last_new, any_value(t.pages)::BIGINT AS pages, any_value(t.last_updated)::BIGINT AS last_updated FROM f JOIN (SELECT space, count(*) AS pages, max(created_at) AS last_updated FROM p GROUP BY 1) t USING (space) GROUP BY f.space
""")
def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    p = d.select(F.concat(F.lit("sp"), (F.col("doc_id") % 7).cast("string")).alias("space"), F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("storage"), F.col("n_chars").alias("created_at"))
    c = p.where("space <> 'sp3'").groupBy("space").agg((F.min("created_at") + 500).alias("cursor"))
    new = R.wiki_pages(p, c).groupBy("space").agg(F.count(F.lit(1)).alias("new_pages"), F.max("created_at").alias("last_new"))
    return new.join(R.space_facts(p), "space")


@query("wiki_attachments", "S15", """
WITH a AS (SELECT 'S' || l_returnflag AS space, l_orderkey AS page_id, 'f' || l_linenumber AS title, floor(l_extendedprice)::BIGINT AS size, CASE WHEN l_linestatus = 'O' THEN '/d' ELSE '' END AS link FROM lineitem)
SELECT space, size <= 50000 AS kept, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM a WHERE link <> '' GROUP BY ALL
""")
def wiki_attachments(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a = li.select(F.concat(F.lit("S"), "l_returnflag").alias("space"), F.col("l_orderkey").alias("page_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("title"), F.col("l_extendedprice").cast("long").alias("size"), F.when(F.col("l_linestatus") == "O", "/d").otherwise("").alias("link"))
    ok, skipped = R.attachments(a, 50000)
    u = ok.select("space", "size", F.lit(True).alias("kept")).unionByName(skipped.select("space", "size", F.lit(False).alias("kept")))
    return u.groupBy("space", "kept").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


_CANON = r"""lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || CASE WHEN regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') END
 || CASE WHEN regexp_extract({0}, '^[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract({0}, '^[^?#]*\?([^#]*)', 1) ELSE '' END"""


@query("url_canonical", "S17", rf"""
SELECT page_id, {_CANON.format('url')} AS uri, CASE WHEN trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) <> '' THEN trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) ELSE url END AS title, md5(html) AS body_md5 FROM pages
""")
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    p = wide_table(spark, sf, "pages")
    return p.select("page_id", R.canonical_url(F.col("url")).alias("uri"), R.page_title(F.col("html"), F.col("url")).alias("title"), F.md5("html").alias("body_md5"))


_EDGES = rf"""
h AS (SELECT url, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"#]*|''[^''#]*|[^\s"''>#]+)', 1), lambda x: trim(regexp_replace(x, '^["'']', ''))))) AS href FROM pages),
a AS (SELECT url, href, {_CANON.format('url')} AS src FROM h WHERE href <> ''),
d AS (SELECT src, url, CASE WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE '/%' THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || href WHEN regexp_matches(href, '^https?://') THEN href WHEN NOT regexp_matches(href, '^[a-zA-Z]+:') THEN regexp_replace(src, '[^/]*$', '') || href END AS dst FROM a),
le AS (SELECT DISTINCT src, {_CANON.format('dst')} AS dst FROM d WHERE dst IS NOT NULL AND lower(regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
  AND NOT regexp_matches(regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(?i)\.(pdf|png|jpg|jpeg|gif|svg|webp|zip|gz|mp4|mp3|css|js|ico|woff2?|ttf|xml|json)$'))"""


@query("link_edges", "S17", f"WITH {_EDGES} SELECT src, dst FROM le")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.link_edges(wide_table(spark, sf, "pages"))


_SEED_EDGES = _EDGES.replace("= lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))\n", "IN (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) FROM pages WHERE url LIKE 'https://%')\n")


@query("crawl_frontier", "S17", f"""
WITH {_SEED_EDGES}, hv AS (SELECT DISTINCT {_CANON.format('url')} AS url FROM pages), s0 AS (SELECT DISTINCT {_CANON.format('url')} AS url FROM pages WHERE url LIKE 'https://%'),
l1 AS (SELECT DISTINCT dst AS url FROM le JOIN s0 ON s0.url = src WHERE dst IN (SELECT url FROM hv) AND dst NOT IN (SELECT url FROM s0)), l2 AS (SELECT DISTINCT dst AS url FROM le JOIN l1 ON l1.url = src WHERE dst IN (SELECT url FROM hv) AND dst NOT IN (SELECT url FROM s0) AND dst NOT IN (SELECT url FROM l1))
SELECT url, 0 AS depth FROM s0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2
""")
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    p = wide_table(spark, sf, "pages")
    return R.crawl(p, p.where(F.col("url").startswith("https://")).select("url"))


_URLS = ["https://github.com/acme/shop.git", "https://github.com/acme", "https://acme.atlassian.net/jira/software/projects/OPS/boards/12", "https://acme.atlassian.net/browse/OPS-7", "https://acme.atlassian.net/wiki/spaces/hr/pages/99/x", "https://acme.atlassian.net/wiki/spaces/hr", "https://acme.atlassian.net/jira/dashboards", "acme/tool", "plainword"]


@query("source_urls", "S27", f"""
WITH e AS (SELECT DISTINCT ({'[' + ','.join(f"'{x}'" for x in _URLS) + ']'})[c_custkey % {len(_URLS)} + 1] AS u FROM customer UNION SELECT DISTINCT url FROM pages),
c AS (SELECT CASE u WHEN 'https://github.com/acme/shop.git' THEN ['github','repo','acme/shop'] WHEN 'https://github.com/acme' THEN ['github','org','acme'] WHEN 'https://acme.atlassian.net/jira/software/projects/OPS/boards/12' THEN ['jira','board','12'] WHEN 'https://acme.atlassian.net/browse/OPS-7' THEN ['jira','project','OPS']
 WHEN 'https://acme.atlassian.net/wiki/spaces/hr/pages/99/x' THEN ['confluence','page','99'] WHEN 'https://acme.atlassian.net/wiki/spaces/hr' THEN ['confluence','space','HR'] WHEN 'https://acme.atlassian.net/jira/dashboards' THEN ['jira','dashboard','*'] WHEN 'acme/tool' THEN ['github','repo','acme/tool'] WHEN 'plainword' THEN NULL ELSE ['website','url',u] END AS c FROM e)
SELECT c[1] AS source, c[2] AS kind, string_agg(DISTINCT c[3], ' ' ORDER BY c[3]) AS values FROM c WHERE c IS NOT NULL GROUP BY ALL
""")
def source_urls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "customer").select(F.element_at(F.array(*[F.lit(x) for x in _URLS]), (F.col("c_custkey") % len(_URLS) + 1).cast("int")).alias("entry"))
    m = R.merge_allow_list(e.unionByName(table(spark, sf, "pages").select(F.col("url").alias("entry"))))
    return m.select("source", "kind", F.array_join("values", " ").alias("values"))


@query("intake_records", "S2 S3", """
SELECT 'upload://' || doc_id || '.md' AS uri, 'text/markdown' AS mime, doc_id::VARCHAR AS title, CASE WHEN lang = 'en' THEN 'analysis' ELSE 'document' END AS source_kind, CASE WHEN lang = 'fr' THEN 'http://x/' || doc_id ELSE 'upload://' || doc_id || '.md' END AS citation_url, '5' AS arrived_at, 'public' AS acl FROM documents
""")
def intake_records(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_table(spark, sf, "documents")
    u = S.uploads(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), F.encode("text", "UTF-8").alias("data"), "lang", "doc_id"), "t1").join(
        d.select(F.concat(F.lit("upload://"), F.col("doc_id").cast("string"), F.lit(".md")).alias("uri"), "lang", "doc_id"), "uri")
    meta = F.when(F.col("lang") == "en", F.create_map(F.lit("source_kind"), F.lit("analysis"), F.lit("_tmp"), F.lit("1"))).when(F.col("lang") == "fr", F.create_map(F.lit("citation_url"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")))).otherwise(F.create_map(F.lit("source_kind"), F.lit("nonsense")))
    s = S.stamp_meta(u.withColumn("meta", meta).withColumn("acl", F.array().cast("array<string>")), 5)
    g = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return s.select("uri", "mime", "title", g("source_kind"), g("citation_url"), g("arrived_at"), F.array_join("acl", ",").alias("acl"))


@query("url_entities", "G26", """
WITH u AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'jira://site/ORD-' || o_orderkey WHEN '2-HIGH' THEN 'github://a/b/pulls/' || o_orderkey WHEN '3-MEDIUM' THEN 'github://a/b/commits/0123456789abcdef' || o_orderkey WHEN '4-NOT SPECIFIED' THEN 'github://a/b/issues/' || o_orderkey ELSE CASE WHEN o_orderstatus = 'F' THEN 'confluence://SP/' || o_orderkey ELSE 'file://x' END END AS uri FROM orders)
SELECT id, CASE WHEN uri LIKE 'jira:%' THEN 'issue' WHEN uri LIKE '%/pulls/%' THEN 'pull_request' WHEN uri LIKE '%/commits/%' THEN 'commit' WHEN uri LIKE '%/issues/%' THEN 'gh_issue' WHEN uri LIKE 'confluence:%' THEN 'page' ELSE 'document' END AS kind,
 CASE WHEN uri LIKE 'jira:%' THEN 'ORD-' || id WHEN uri LIKE '%/pulls/%' THEN 'a/b#' || id WHEN uri LIKE '%/commits/%' THEN 'a/b@0123456789ab' WHEN uri LIKE '%/issues/%' THEN 'a/b!' || id WHEN uri LIKE 'confluence:%' THEN 'SP/' || id ELSE id::VARCHAR END AS entity FROM u
""")
def url_entities(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graph import uri_entity

    k = F.col("o_orderkey").cast("string")
    pr = F.col("o_orderpriority")
    uri = F.when(pr == "1-URGENT", F.concat(F.lit("jira://site/ORD-"), k)).when(pr == "2-HIGH", F.concat(F.lit("github://a/b/pulls/"), k)).when(pr == "3-MEDIUM", F.concat(F.lit("github://a/b/commits/0123456789abcdef"), k)).when(pr == "4-NOT SPECIFIED", F.concat(F.lit("github://a/b/issues/"), k)).when(F.col("o_orderstatus") == "F", F.concat(F.lit("confluence://SP/"), k)).otherwise("file://x")
    kind, ent = uri_entity(uri, F.col("o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), ent.alias("entity"))
