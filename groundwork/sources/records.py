"""Record sources: issue trackers, code hosts, wikis, activity, urls."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Test, pipeline and generated-documentation paths kept out of the code source.
EXCLUDED_FILE = r"(^|/)(test_[^/]+\.py|[^/]+_test\.py|[^/]+\.spec\.[^/]+|conftest\.py)$"
EXCLUDED_DIR = r"(^|/)(tests|test|__tests__|spec|\.github|docs/progress)(/|$)"


def excluded_path(path: Column) -> Column:
    p = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return p.rlike(EXCLUDED_FILE) | p.rlike(EXCLUDED_DIR)


def issue_body() -> Column:
    return F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("["), "key", F.lit("]")), "summary"), F.concat(F.lit("Status: "), "status"), "description")


def pull_delta(records: DataFrame, allow: DataFrame, cursor: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(changed, deleted) rows of allowed scopes newer than the scope's cursor.

    ``records``: (scope, updated, deleted boolean, ...); ``cursor``: (scope, cursor).
    """
    r = records.join(allow.select(scope), scope, "left_semi").join(cursor, scope, "left")
    r = r.where(F.col("cursor").isNull() | (F.col("updated") > F.col("cursor"))).drop("cursor")
    d = F.coalesce("deleted", F.lit(False))
    return r.where(~d), r.where(d)


def changed_scopes(current: DataFrame, cursor: DataFrame) -> DataFrame:
    """Repositories whose push time is not the one in the cursor table."""
    return current.join(cursor.select("repo", "pushed_at"), ["repo", "pushed_at"], "left_anti")


ISSUE_SCHEMA = (
    "id string, key string, fields struct<summary: string, description: string, status: struct<name: string>, assignee: struct<displayName: string>, priority: struct<name: string>, "
    "issuetype: struct<name: string>, labels: array<string>, project: struct<key: string>, parent: struct<key: string>, created: string, updated: string, "
    "sprint: array<struct<name: string, state: string>>, comment: struct<comments: array<struct<id: string, author: struct<displayName: string>, created: string, body: string>>>, "
    "issuelinks: array<struct<type: struct<name: string, outward: string, inward: string>, outwardIssue: struct<key: string, fields: struct<summary: string>>, inwardIssue: struct<key: string, fields: struct<summary: string>>>>>"
)


def rich_text(node: object) -> str:
    """Plain paragraphs of a rich-text tree; plain strings pass through."""
    if node is None:
        return ""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(rich_text(n) for n in node)
    kind = node.get("type")
    if kind == "text":
        return node.get("text", "")
    if kind in ("mention", "emoji"):
        return str((node.get("attrs") or {}).get("text", ""))
    if kind == "hardBreak":
        return "\n"
    inner = rich_text(node.get("content"))
    if kind in ("paragraph", "heading", "codeBlock", "blockquote"):
        return inner.strip() + "\n\n"
    if kind == "listItem":
        return "- " + inner.strip() + "\n"
    return inner


@F.pandas_udf(T.StringType())
def flatten_rich_text(body: pd.Series) -> pd.Series:
    def one(s):
        if not s:
            return ""
        try:
            node = json.loads(s)
        except ValueError:
            return s
        return rich_text(node).strip() if isinstance(node, (dict, list)) else s

    return body.map(one)


def flatten_issues(raw: DataFrame, base_url: str, body: str = "body") -> DataFrame:
    """Nested issue JSON to flat rows: defaults, active-first sprint, comments and links arrays."""
    j = raw.select(F.from_json(body, ISSUE_SCHEMA).alias("i")).where("i.key is not null")
    f = F.col("i.fields")
    e = lambda c: F.coalesce(c, F.lit(""))
    sp = F.transform(f["sprint"], lambda s: F.struct(e(s["name"]).alias("name"), F.lower(e(s["state"])).alias("state")))
    active = F.filter(sp, lambda s: s["state"] == "active")
    # the last active sprint in the list wins, else the first one
    sprint = F.coalesce(F.try_element_at(active, F.lit(-1)), F.try_element_at(sp, F.lit(1)))
    link = lambda o, d: F.struct(e(o["type"]["name"]).alias("type"), F.coalesce(o["type"][d[0]], o["type"]["name"], F.lit("")).alias("direction"), e(o[d[1]]["key"]).alias("key"), e(o[d[1]]["fields"]["summary"]).alias("summary"))
    links = F.transform(F.filter(f["issuelinks"], lambda o: o["outwardIssue"].isNotNull() | o["inwardIssue"].isNotNull()), lambda o: F.when(o["outwardIssue"].isNotNull(), link(o, ("outward", "outwardIssue"))).otherwise(link(o, ("inward", "inwardIssue"))))
    comments = F.transform(f["comment"]["comments"], lambda c: F.struct(e(c["id"]).alias("id"), e(c["author"]["displayName"]).alias("author"), e(c["created"]).alias("created"), e(c["body"]).alias("body")))
    return j.select(
        F.col("i.key").alias("key"), F.coalesce(f["project"]["key"], F.element_at(F.split("i.key", "-"), 1)).alias("project"), e(f["summary"]).alias("summary"), flatten_rich_text(f["description"]).alias("description"), e(f["status"]["name"]).alias("status"),
        F.coalesce(F.nullif(f["assignee"]["displayName"], F.lit("")), F.lit("Unassigned")).alias("assignee"), e(f["priority"]["name"]).alias("priority"), e(f["issuetype"]["name"]).alias("type"), F.coalesce(f["labels"], F.array().cast("array<string>")).alias("labels"),
        sprint.alias("sprint"), e(f["parent"]["key"]).alias("parent"), e(f["created"]).alias("created"), e(f["updated"]).alias("updated"), F.concat(F.lit(f"{base_url}/browse/"), "i.key").alias("url"),
        F.coalesce(comments, F.array().cast("array<struct<id:string,author:string,created:string,body:string>>")).alias("comments"), F.coalesce(links, F.array().cast("array<struct<type:string,direction:string,key:string,summary:string>>")).alias("links"),
    )


def repository_facts(languages: DataFrame, contributors: DataFrame, pulls: DataFrame, releases: DataFrame, deployments: DataFrame) -> DataFrame:
    """One facts row per repository from normalised snapshot tables.

    languages (repo, language, bytes); contributors (repo, login, contributions); pulls (repo, state,
    merged, additions, deletions, changed_files); releases (repo, tag, published_at); deployments
    (repo, environment, status, at).
    """
    total = languages.groupBy("repo").agg(F.sum("bytes").alias("_t"))
    lang = languages.join(total, "repo").withColumn("share", F.round(F.col("bytes") / F.greatest(F.col("_t"), F.lit(1)), 4))
    langs = lang.groupBy("repo").agg(F.max_by("language", F.struct("bytes", "language")).alias("primary_language"), F.max("share").alias("top_share"), F.count(F.lit(1)).alias("languages"))
    con = contributors.groupBy("repo").agg(F.count(F.lit(1)).alias("contributors_count"), F.max_by("login", F.struct("contributions", "login")).alias("top_contributor"))
    m = F.col("merged")
    pr = pulls.groupBy("repo").agg(
        F.count_if(~m & (F.col("state") == "open")).alias("pr_open"), F.count_if(~m & (F.col("state") == "closed")).alias("pr_closed"), F.count_if(m).alias("pr_merged"), F.count(F.lit(1)).alias("pr_total"),
        F.coalesce(F.round(F.avg(F.when(m, F.col("additions")))), F.lit(0.0)).cast("long").alias("mean_additions"), F.coalesce(F.round(F.avg(F.when(m, F.col("changed_files")))), F.lit(0.0)).cast("long").alias("mean_files"),
    )
    rel = releases.groupBy("repo").agg(F.count(F.lit(1)).alias("releases"), F.max_by("tag", F.struct("published_at", "tag")).alias("latest_release"))
    dep = deployments.groupBy("repo", "environment").agg(F.max_by("status", "at").alias("s")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("environment", "s")))).alias("deployments"))
    return langs.join(con, "repo", "full").join(pr, "repo", "full").join(rel, "repo", "full").join(dep, "repo", "full")


def language_shares(languages: DataFrame) -> DataFrame:
    """Language bar: share of bytes per repository, four places."""
    t = languages.groupBy("repo").agg(F.sum("bytes").alias("_t"))
    return languages.join(t, "repo").select("repo", "language", "bytes", F.round(F.col("bytes") / F.greatest(F.col("_t"), F.lit(1)), 4).alias("share"))


def activity_passages(pulls: DataFrame, commits: DataFrame, commit_cap: int = 200) -> DataFrame:
    """Pull requests and commits as passages: (repo, uri, pos, kind, passage).

    pulls: (repo, number, state, author, title, opened, merged_at, base, head, additions, deletions,
    changed_files, body, reviews array<struct<author, state, body>>, files array<string>).
    commits: (repo, sha, author, at, message). The newest ``commit_cap`` commits of a repository have
    a record each; older ones share the history record, one passage per commit.
    """
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("Pull request #"), s("number"), F.lit(" ("), s("state"), F.lit(") by "), s("author"), F.lit(": "), s("title"), F.lit(". Opened "), s("opened"), F.when(F.col("merged_at").isNotNull(), F.concat(F.lit(", merged "), s("merged_at"))).otherwise(""), F.lit(". "), s("base"), F.lit(" ← "), s("head"), F.lit("; +"), s("additions"), F.lit("/−"), s("deletions"), F.lit(" in "), s("changed_files"), F.lit(" files."))
    one = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("passage"))
    parts = F.concat(
        F.array(one("pull_request", head)), F.filter(F.array(one("pull_request_body", s("body"))), lambda x: x["passage"] != ""),
        F.transform("reviews", lambda r: one("review", F.concat(F.lit("Review by "), r["author"], F.lit(" ("), r["state"], F.lit("): "), F.coalesce(r["body"], F.lit(""))))),
        F.filter(F.array(one("files", F.concat(F.lit("Files changed: "), F.array_join("files", ", ")))), lambda x: x["passage"] != "Files changed: "),
    )
    p = pulls.select("repo", F.concat(F.lit("github://"), "repo", F.lit("/pulls/"), s("number")).alias("uri"), F.posexplode(parts).alias("pos", "x")).select("repo", "uri", F.col("pos").cast("long").alias("pos"), "x.*")
    w = Window.partitionBy("repo").orderBy(F.desc("at"), "sha")
    c = commits.withColumn("_r", F.row_number().over(w))
    text = F.concat(F.lit("Commit "), F.substring("sha", 1, 12), F.lit(" by "), s("author"), F.lit(" on "), s("at"), F.lit(": "), s("message"))
    own = F.col("_r") <= commit_cap
    c = c.select("repo", F.when(own, F.concat(F.lit("github://"), "repo", F.lit("/commits/"), "sha")).otherwise(F.concat(F.lit("github://"), "repo", F.lit("/commits/history"))).alias("uri"), F.when(own, F.lit(0)).otherwise(F.col("_r") - commit_cap - 1).cast("long").alias("pos"), F.lit("commit").alias("kind"), text.alias("passage"))
    return p.unionByName(c)


def wiki_pages(pages: DataFrame, cursor: DataFrame) -> DataFrame:
    """Pages newer than their space's cursor, body with the title as heading."""
    j = pages.join(cursor, "space", "left").where(F.col("cursor").isNull() | (F.col("created_at") > F.col("cursor")))
    return j.select("space", "page_id", F.concat(F.lit("confluence://"), "space", F.lit("/"), F.col("page_id").cast("string")).alias("uri"), F.concat(F.lit("<h1>"), "title", F.lit("</h1>"), "storage").alias("html"), "created_at")


def space_facts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("space").agg(F.count(F.lit(1)).alias("pages"), F.max("created_at").alias("last_updated"))


def attachments(rows: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(records, skipped with reason): attachments with a link, split on the size cap."""
    have = rows.where(F.coalesce("link", F.lit("")) != "")
    uri = F.concat(F.lit("confluence://"), "space", F.lit("/"), F.col("page_id").cast("string"), F.lit("/attachments/"), "title")
    ok = have.where(F.col("size") <= max_bytes).withColumn("uri", uri)
    return ok, have.where(F.col("size") > max_bytes).withColumn("reason", F.concat(F.col("size").cast("string"), F.lit(" bytes > cap")))


# ---- web ----------------------------------------------------------------------------------
BINARY_END = r"(?i)\.(pdf|png|jpg|jpeg|gif|svg|webp|zip|gz|mp4|mp3|css|js|ico|woff2?|ttf|xml|json)$"  # fixed values


def url_parts(url: Column) -> dict[str, Column]:
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "host": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
        "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1),
    }


def canonical_url(url: Column) -> Column:
    """Lower-case host, no closing slash, no fragment."""
    p = url_parts(url)
    path = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(p["scheme"], F.lit("://"), p["host"], path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))


def page_title(html: Column, url: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(t != "", t).otherwise(url)


def website_records(pages: DataFrame, crawled_at: str) -> DataFrame:
    return pages.select(F.lit("website").alias("source"), canonical_url(F.col("url")).alias("uri"), F.lit("text/html").alias("mime"), page_title(F.col("html"), F.col("url")).alias("title"), F.lit(crawled_at).alias("source_version"), F.col("html").alias("body"))


#: The value of a link's href: in double quotes, in single quotes or bare, up to a fragment.
HREF = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"#]*|'[^'#]*|[^\s"'>#]+)"""


def hosts_of(urls: DataFrame) -> DataFrame:
    return urls.select(url_parts(F.col("url"))["host"].alias("host")).where("host <> ''").distinct()


def link_edges(pages: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) canonical links, binary endings skipped: to pages of the same host, or of any of ``hosts`` (host)."""
    p = url_parts(F.col("url"))
    found = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "^[\"']", "")))
    h = pages.select(canonical_url(F.col("url")).alias("src"), F.concat(p["scheme"], F.lit("://"), p["host"]).alias("_root"), p["host"].alias("_host"), F.explode(F.array_distinct(found)).alias("href")).where("href <> ''")
    dst = F.when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href")).when(F.col("href").startswith("/"), F.concat("_root", "href")).when(F.col("href").rlike("^https?://"), F.col("href")).when(~F.col("href").rlike("^[a-zA-Z]+:"), F.concat(F.regexp_replace("src", r"[^/]*$", ""), F.col("href")))
    e = h.withColumn("_d", dst).where("_d is not null")
    q = url_parts(F.col("_d"))
    e = e.where(~q["path"].rlike(BINARY_END))
    e = e.where(q["host"] == F.col("_host")) if hosts is None else e.withColumn("host", q["host"]).join(hosts, "host", "left_semi")
    return e.select("src", canonical_url(F.col("_d")).alias("dst")).distinct()


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = 2, max_pages: int | None = None) -> DataFrame:
    """Stored pages reached from the seed urls breadth-first: (url, depth). Links lead to any host that a seed has.

    ``max_pages`` is the crawl budget; pages nearer the seeds come first.
    """
    from ..session import cut_lineage

    have = pages.select(canonical_url(F.col("url")).alias("url")).distinct()
    edges = cut_lineage(link_edges(pages, hosts_of(seeds)))
    front = seeds.select(canonical_url(F.col("url")).alias("url")).distinct().join(have, "url", "left_semi").withColumn("depth", F.lit(0))
    seen = front
    for d in range(1, depth + 1):
        nxt = front.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        front = cut_lineage(nxt.join(have, "url", "left_semi").join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def classify_source_url(entry: Column) -> Column:
    """struct<source, kind, value, site> of a pasted url: what to connect to and the named thing in it."""
    s = F.trim(F.coalesce(entry, F.lit("")))
    scheme = s.contains("://")
    full = F.when(scheme, s).otherwise(F.concat(F.lit("https://"), s))
    p = url_parts(full)
    segs = F.filter(F.split(p["path"], "/"), lambda x: x != "")
    seg = lambda i: F.coalesce(F.try_element_at(segs, F.lit(i)), F.lit(""))
    after = lambda w: F.coalesce(F.try_element_at(segs, F.array_position(segs, w).cast("int") + 1), F.lit(""))
    has = lambda w: F.array_contains(segs, w)
    low = F.lower(s)
    site = F.concat(p["scheme"], F.lit("://"), p["host"])
    out = lambda src, kind, val, st=F.lit(""): F.struct(F.lit(src).alias("source"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), val.alias("value"), st.alias("site"))
    gh = p["host"].isin("github.com", "www.github.com")
    atl = p["host"].endswith("atlassian.net") | low.contains("/wiki/") | low.contains("/jira/")
    wiki = low.contains("/wiki/") | (seg(1) == "wiki")
    num = lambda v: F.regexp_extract(v, r"^(\d+)", 1)
    return (
        F.when(s == "", F.lit(None))
        .when(gh & (F.size(segs) >= 2), out("github", "repo", F.concat(seg(1), F.lit("/"), F.regexp_replace(seg(2), r"\.git$", ""))))
        .when(gh & (F.size(segs) == 1), out("github", "org", seg(1))).when(gh, out("github", "all", F.lit("")))
        .when(atl & wiki & (num(after("pages")) != ""), out("confluence", "page", after("pages"), site)).when(atl & wiki & has("spaces") & (after("spaces") != ""), out("confluence", "space", F.upper(after("spaces")), site)).when(atl & wiki, out("confluence", "all", F.lit(""), site))
        .when(atl & has("dashboards"), out("jira", "dashboard", F.when(num(after("dashboards")) != "", num(after("dashboards"))).otherwise("*"), site))
        .when(atl & has("boards") & (num(after("boards")) != ""), out("jira", "board", num(after("boards")), site))
        .when(atl & has("browse") & (after("browse") != ""), out("jira", "project", F.upper(F.element_at(F.split(after("browse"), "-"), 1)), site)).when(atl & has("projects") & (after("projects") != ""), out("jira", "project", F.upper(after("projects")), site)).when(atl, out("jira", "all", F.lit(""), site))
        .when(scheme & (p["host"] != ""), out("website", "url", s)).when(~scheme & s.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), out("github", "repo", s))
    )


def merge_allow_list(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Distinct named things per source and kind: (source, kind, values array)."""
    c = entries.select(classify_source_url(F.col(entry)).alias("c")).where("c is not null").select("c.*").distinct()
    return c.groupBy("source", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
