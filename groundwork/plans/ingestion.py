"""Ingest, versions, tombstones, schedules and runs over the test tables.

Store: documents as version 1 (uri doc://source/id). Incoming batch: English documents unchanged,
French and German ones without their last line, Spanish ones absent, and every web page as new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V
from ..registry import query
from ..session import table, wide_table

SHORT = r"regexp_replace(text, '\n[^\n]*$', '')"


def store(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_table(spark, sf, "documents")
    return d.select(
        F.lit("t1").alias("tenant"), F.col("doc_id").cast("string").alias("document_id"), "source",
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("uri"), "text", "lang",
        V.content_hash(F.col("text")).alias("content_hash"), F.lit(1).cast("long").alias("current_version"), F.lit("active").alias("status"),
    )


def two_tenants(docs: DataFrame) -> DataFrame:
    """The same documents in a second tenant, under other ids."""
    return docs.unionByName(docs.withColumn("tenant", F.lit("t2")).withColumn("document_id", F.concat(F.lit("b"), "document_id")))


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    s = store(spark, sf).where("lang <> 'es'")
    s = s.withColumn("text", F.when(F.col("lang").isin("fr", "de"), F.expr(SHORT.replace("\\n", "\\\\n"))).otherwise(F.col("text")))
    p = wide_table(spark, sf, "pages").select(F.lit("t1").alias("tenant"), F.lit("website").alias("source"), F.col("url").alias("uri"), F.col("html").alias("text"))
    p = p.groupBy("tenant", "source", "uri").agg(F.max("text").alias("text"))
    return s.select("tenant", "source", "uri", "text").unionByName(p).withColumn("content_hash", V.content_hash(F.col("text")))


_SQL_STORE = r"""st AS (SELECT doc_id::VARCHAR AS document_id, source, 'doc://' || source || '/' || doc_id AS uri, text, lang, sha256(text) AS h FROM documents),
inc AS (SELECT source, uri, CASE WHEN lang IN ('fr','de') THEN regexp_replace(text, '\n[^\n]*$', '') ELSE text END AS text FROM st WHERE lang <> 'es'
  UNION ALL SELECT 'website', url, max(html) FROM pages GROUP BY url),
df AS (SELECT i.source, i.uri, i.text, CASE WHEN st.uri IS NULL THEN 'ok' WHEN st.h = sha256(i.text) THEN 'noop' ELSE 'updated' END AS status
  FROM inc i LEFT JOIN st ON st.source = i.source AND st.uri = i.uri)"""


@query("ingest_diff", "J4 V1 V2 S22 V14", f"""
WITH {_SQL_STORE} SELECT source, uri, status, (CASE status WHEN 'updated' THEN 2 ELSE 1 END)::BIGINT AS version, sha256(text) AS content_hash FROM df
""")
def ingest_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = V.ingest_diff(incoming(spark, sf), store(spark, sf))
    return d.select("source", "uri", "status", F.col("version").cast("long").alias("version"), "content_hash")


def passages_of(docs: DataFrame, version: int, *more: Column | str) -> DataFrame:
    """One passage per line, with ``more`` columns of its document."""
    p = docs.select("document_id", "content_hash", *more, F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("text <> ''")
    pid = F.concat_ws(":", "document_id", F.lit(str(version)), F.col("pos").cast("string"))
    return p.select(
        pid.alias("passage_id"), "document_id", F.lit(version).cast("long").alias("version"), F.col("pos").cast("long").alias("pos"),
        "text", "content_hash", F.lit("1").alias("source_version"), F.lit(None).cast("string").alias("superseded_by"), *[c for c in p.columns if c not in ("document_id", "content_hash", "pos", "text")],
    )


def two_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    st = store(spark, sf)
    d = V.ingest_diff(incoming(spark, sf), st)
    upd = d.where("status = 'updated'")
    p1 = passages_of(st, 1)
    p2 = passages_of(upd, 2)
    return upd, p1, p2


_SQL_PASS = _SQL_STORE + r""",
upd AS (SELECT substr(uri, length(source) + 8) AS document_id, text FROM df WHERE status = 'updated'),
l1 AS (SELECT document_id, 1 AS version, unnest(string_split(text, e'\n')) AS text, generate_subscripts(string_split(text, e'\n'), 1) - 1 AS pos FROM st),
l2 AS (SELECT document_id, 2 AS version, unnest(string_split(text, e'\n')) AS text, generate_subscripts(string_split(text, e'\n'), 1) - 1 AS pos FROM upd),
p1 AS (SELECT * FROM l1 WHERE text <> ''), p2 AS (SELECT * FROM l2 WHERE text <> '')"""


@query("supersede", "V3 V6 C3", f"""
WITH {_SQL_PASS}, a AS (SELECT p1.document_id, version, pos, CASE WHEN u.document_id IS NOT NULL THEN 'v2' END AS superseded_by
  FROM p1 LEFT JOIN upd u ON u.document_id = p1.document_id UNION ALL SELECT document_id, version, pos, NULL FROM p2)
SELECT document_id, version::BIGINT AS version, count(*)::BIGINT AS passages, (count(*) FILTER (superseded_by IS NULL))::BIGINT AS live FROM a GROUP BY ALL
""")
def supersede(spark: SparkSession, sf: str) -> DataFrame:
    upd, p1, p2 = two_versions(spark, sf)
    allp = V.supersede(p1, upd.select("document_id", "version")).unionByName(p2)
    return allp.groupBy("document_id", "version").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if(F.col("superseded_by").isNull()).alias("live")
    )


@query("version_diff", "V9", f"""
WITH {_SQL_PASS}, c1 AS (SELECT document_id, text, count(*) AS a FROM p1 WHERE document_id IN (SELECT document_id FROM upd) GROUP BY ALL),
c2 AS (SELECT document_id, text, count(*) AS b FROM p2 GROUP BY ALL),
j AS (SELECT coalesce(c1.document_id, c2.document_id) AS document_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM c1 FULL JOIN c2 ON c1.document_id = c2.document_id AND c1.text = c2.text)
SELECT document_id, sum(greatest(b - a, 0))::BIGINT AS added, sum(greatest(a - b, 0))::BIGINT AS removed, sum(least(a, b))::BIGINT AS unchanged FROM j GROUP BY 1
""")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    upd, p1, p2 = two_versions(spark, sf)
    return V.version_diff(p1.join(upd.select("document_id"), "document_id", "left_semi"), p2)


@query("version_diff_rows", "V9", f"""
WITH {_SQL_PASS}, m AS (SELECT document_id, pos, text, row_number() OVER (PARTITION BY document_id, text ORDER BY pos) AS n,
  count(*) OVER (PARTITION BY document_id, text) AS mine FROM p1 WHERE document_id IN (SELECT document_id FROM upd)),
o AS (SELECT document_id, text, count(*) AS o FROM p2 GROUP BY ALL)
SELECT m.document_id, 'removed' AS change, m.pos::BIGINT AS pos, md5(m.text) AS text_md5 FROM m LEFT JOIN o ON o.document_id = m.document_id AND o.text = m.text WHERE n <= mine - coalesce(o.o, 0)
""")
def version_diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    upd, p1, p2 = two_versions(spark, sf)
    d = V.diff_rows(p1.join(upd.select("document_id"), "document_id", "left_semi"), p2)
    return d.select("document_id", "change", "pos", F.md5("text").alias("text_md5"))


@query("rollback", "V10 V8 V11", f"""
WITH {_SQL_PASS}, n1 AS (SELECT document_id, count(*) AS n FROM p1 GROUP BY 1), n2 AS (SELECT document_id, count(*) AS n FROM p2 GROUP BY 1)
SELECT u.document_id, 1::BIGINT AS to_version, n1.n IS NOT NULL AS ok, CASE WHEN n1.n IS NOT NULL THEN 3 END::BIGINT AS new_version, n1.n::BIGINT AS reactivated,
  CASE WHEN n1.n IS NOT NULL THEN coalesce(n2.n, 0) END::BIGINT AS superseded
FROM upd u LEFT JOIN n1 USING (document_id) LEFT JOIN n2 USING (document_id)
""")
def rollback(spark: SparkSession, sf: str) -> DataFrame:
    return rolled_back(spark, sf)["outcome"]


def rolled_back(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    upd, p1, p2 = two_versions(spark, sf)
    allp = V.supersede(p1, upd.select("document_id", "version")).unionByName(p2)
    docs = V.upsert(store(spark, sf).select("document_id", "content_hash", "current_version"), upd.select("document_id", "content_hash", F.col("version").alias("current_version")), ["document_id"])
    summary, rows = V.record_versions(allp)
    req = upd.select("document_id", F.lit(1).cast("long").alias("to_version"))
    return V.rollback(docs, allp, summary, rows, req)


@query("rollback_passages", "V10 J6", f"""
WITH {_SQL_PASS}, a AS (SELECT document_id, version, pos, NULL AS superseded_by FROM p1 UNION ALL SELECT document_id, version, pos, 'v3' FROM p2)
SELECT document_id, version::BIGINT AS version, pos::BIGINT AS pos, superseded_by FROM a
""")
def rollback_passages(spark: SparkSession, sf: str) -> DataFrame:
    return rolled_back(spark, sf)["passages"].select("document_id", "version", "pos", "superseded_by")


@query("version_history", "V7 V8", f"""
WITH {_SQL_PASS} SELECT document_id, version::BIGINT AS version, count(*)::BIGINT AS passages, version = 2 AS recorded FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY document_id, version
""")
def version_history(spark: SparkSession, sf: str) -> DataFrame:
    _, p1, p2 = two_versions(spark, sf)
    ledger, _ = V.record_versions(p2)  # version 1 was never recorded and comes from the passages
    return V.history(ledger, p1.unionByName(p2)).select("document_id", "version", "passages", "recorded")


@query("lineage", "V13 J2 C3", f"""
WITH {_SQL_PASS} SELECT p.document_id, p.pos::BIGINT AS pos, p.version::BIGINT AS version, st.uri, st.source, st.h AS document_hash, u.document_id IS NULL AS live
FROM p1 p JOIN st USING (document_id) LEFT JOIN upd u USING (document_id)
""")
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    upd, p1, _ = two_versions(spark, sf)
    p = V.supersede(p1, upd.select("document_id", "version")).drop("content_hash")
    out = V.lineage(p, store(spark, sf))
    return out.select("document_id", "pos", "version", "uri", "source", "document_hash", "live")


@query("tombstone_sync", "J7 V21 J8 S5", """
WITH d AS (SELECT doc_id, source, CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'tombstoned' ELSE 'active' END AS status FROM documents LEFT JOIN labels l USING (doc_id)),
b AS (SELECT 't1' AS tenant, source, status FROM d UNION ALL SELECT 't2', source, 'active' FROM d)
SELECT tenant, source, status, count(*)::BIGINT AS documents, sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END)::BIGINT AS passages_left FROM b GROUP BY ALL
""")
def tombstone_sync(spark: SparkSession, sf: str) -> DataFrame:
    st = two_tenants(store(spark, sf))
    p = st.select(F.col("document_id").alias("passage_id"), "document_id")
    gone = table(spark, sf, "labels").where("quality = 0 and toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    docs, left, _ = V.tombstone(st, p, p.select("passage_id"), st.join(gone, "document_id", "left_semi").select("tenant", "source", "uri"))
    n = left.withColumn("_p", F.lit(1))
    j = docs.join(n.select("document_id", "_p"), "document_id", "left")
    return j.groupBy("tenant", "source", "status").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("_p", F.lit(0))).cast("long").alias("passages_left"))


@query("bulk_tombstone", "V21", """
WITH hit AS (SELECT doc_id FROM documents WHERE 'doc://' || source || '/' || doc_id LIKE 'doc://src1/%')
SELECT 'curator' AS subject, 'document.delete' AS action, 'document:' || doc_id AS resource, 'allow' AS decision, (SELECT count(*) FROM documents) AS other_tenant FROM hit
""")
def bulk_tombstone(spark: SparkSession, sf: str) -> DataFrame:
    st = two_tenants(store(spark, sf))
    p = st.select(F.col("document_id").alias("passage_id"), "document_id")
    out = V.bulk_tombstone(st, p, p, F.col("uri").startswith("doc://src1/") & (F.col("tenant") == "t1"), "curator", F.lit(0))
    rest = out["documents"].where("tenant = 't2' and status = 'active'").agg(F.count(F.lit(1)).alias("other_tenant"))
    return out["audit"].drop("at").crossJoin(rest)


@query("changed_only", "J5", f"""
WITH {_SQL_STORE} SELECT i.source, i.uri FROM inc i WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.uri = i.uri AND st.h = sha256(i.text))
""")
def changed_only(spark: SparkSession, sf: str) -> DataFrame:
    i = incoming(spark, sf).withColumn("document_id", F.col("uri"))
    s = store(spark, sf).withColumn("document_id", F.col("uri"))
    return V.changed_only(i, s).select("source", "uri")


@query("missing_vectors", "J6", """
SELECT doc_id::VARCHAR AS passage_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    p = store(spark, sf).select(F.col("document_id").alias("passage_id"), F.lit(None).cast("string").alias("superseded_by"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("passage_id"))
    return V.missing_vectors(p, v).select("passage_id")


@query("sync_cursor", "V5 S5 S6 S13 T2 J8", """
WITH r AS (SELECT event_id, event_type AS source, user_id, (epoch_us(ts) // 1000) AS updated, event_type || ':' || user_id AS uri,
   json_extract_string(props, '$.k')::BIGINT > 90 AS deleted FROM events),
c AS (SELECT event_type AS source, (epoch_us(min(ts)) // 1000) + 15 * 86400000 AS cursor, count(DISTINCT user_id) AS items FROM events WHERE event_type <> 'signup' GROUP BY 1),
f AS (SELECT r.* FROM r LEFT JOIN c USING (source) WHERE source IN ('click','view','signup','error') AND (cursor IS NULL OR updated > cursor)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source, uri ORDER BY updated DESC, event_id DESC) = 1),
m AS (SELECT source, max(updated) AS nc, count(*) FILTER (NOT deleted) AS pulled, count(*) FILTER (deleted) AS tombstoned FROM l GROUP BY 1)
SELECT coalesce(c.source, m.source) AS source, greatest(cursor, nc)::BIGINT AS cursor, (coalesce(items, 0) + coalesce(pulled, 0))::BIGINT AS items,
  coalesce(pulled, 0)::BIGINT AS pulled, coalesce(tombstoned, 0)::BIGINT AS tombstoned FROM c FULL JOIN m ON c.source = m.source
""")
def sync_cursor(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    r = e.select(
        F.lit("t1").alias("tenant"), F.col("event_id").alias("change_id"), F.col("event_type").alias("source"), F.col("event_type").alias("scope"), ms.alias("updated"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("uri"), (F.get_json_object("props", "$.k").cast("long") > 90).alias("deleted"),
    )
    c = e.where("event_type <> 'signup'").groupBy(F.lit("t1").alias("tenant"), F.col("event_type").alias("source")).agg((F.min(ms) + 15 * 86400000).alias("cursor"), F.count_distinct("user_id").alias("items"))
    allow = spark.createDataFrame([("t1", s, s) for s in ("click", "view", "signup", "error")], "tenant string, source string, scope string")
    return V.sync(r, c, allow)["cursor"].drop("tenant")


NOW_S = 1009843200  # 2002-01-01

_SQL_SCHED = f"""
o AS (SELECT n_nationkey, n_name, n_regionkey, max((epoch_us(o_orderdate) // 1000)) FILTER (o_orderstatus = 'F') / 1000 AS last_run,
  max((epoch_us(o_orderdate) // 1000)) FILTER (o_orderstatus = 'O') AS last_sync, count(*) AS items, count(*) FILTER (o_orderstatus = 'P') % 7 AS error_count
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
sched AS (SELECT n_name AS source, n_regionkey <> 2 AS enabled, n_nationkey <> 3 AS connector_enabled, 3600 * 24 * (n_nationkey + 100) AS interval_s, last_run, error_count,
  last_run + 3600 * 24 * (n_nationkey + 100) AS next_run FROM o WHERE n_regionkey <> 4),
cur AS (SELECT n_name AS source, last_sync, items FROM o WHERE n_regionkey <> 1)"""


def schedules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey)
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    g = j.groupBy("n_nationkey", "n_name", "n_regionkey").agg(
        (F.max(F.when(F.col("o_orderstatus") == "F", ms)) / 1000).alias("last_run"), F.max(F.when(F.col("o_orderstatus") == "O", ms)).alias("last_sync"),
        F.count(F.lit(1)).alias("items"), (F.count_if(F.col("o_orderstatus") == "P") % 7).alias("error_count"),
    )
    iv = F.lit(86400) * (F.col("n_nationkey") + 100)
    s = g.where("n_regionkey <> 4").select(
        F.col("n_name").alias("source"), (F.col("n_regionkey") != 2).alias("enabled"), (F.col("n_nationkey") != 3).alias("connector_enabled"),
        iv.alias("interval_s"), "last_run", "error_count", (F.col("last_run") + iv).alias("next_run"),
    )
    return s, g.where("n_regionkey <> 1").select(F.col("n_name").alias("source"), "last_sync", "items")


@query("source_health", "V15", f"""
WITH {_SQL_SCHED} SELECT source, items::BIGINT AS items, round(({NOW_S}000 - last_sync) / 60000e0, 1) AS freshness_minutes, last_sync::BIGINT AS last_sync FROM cur
""")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    return V.source_health(schedules(spark, sf)[1], NOW_S * 1000)


@query("due_schedules", "V16 V18", f"""
WITH {_SQL_SCHED} SELECT source, next_run::DOUBLE AS next_run, ({NOW_S} + interval_s * least(4, 1 + error_count))::DOUBLE AS backed_off FROM sched WHERE enabled AND next_run <= {NOW_S}
""")
def due_schedules(spark: SparkSession, sf: str) -> DataFrame:
    s = V.due(schedules(spark, sf)[0], NOW_S)
    return s.select("source", F.col("next_run").cast("double").alias("next_run"), V.back_off(F.lit(NOW_S), F.col("interval_s"), F.col("error_count")).cast("double").alias("backed_off"))


@query("refresh_health", "V17", f"""
WITH {_SQL_SCHED}, j AS (SELECT coalesce(s.source, c.source) AS source, enabled AND connector_enabled AS en, interval_s, coalesce(error_count, 0) AS ec, coalesce(items, 0) AS items,
  round(greatest(0e0, {NOW_S} - greatest(last_run::DOUBLE, last_sync / 1000e0)) / 60e0, 1) AS fresh FROM sched s FULL JOIN cur c ON s.source = c.source)
SELECT source, coalesce(en, FALSE) AS enabled, fresh AS freshness_minutes, ec::BIGINT AS error_count, items::BIGINT AS items,
  coalesce(CASE WHEN en THEN CASE WHEN fresh IS NOT NULL THEN fresh > 2 * interval_s / 60e0 ELSE ec > 0 END ELSE FALSE END, FALSE) AS sla_breach FROM j
""")
def refresh_health(spark: SparkSession, sf: str) -> DataFrame:
    s, c = schedules(spark, sf)
    return V.refresh_health(s, c, NOW_S)


@query("run_rollup", "V19 T6", """
SELECT user_id AS run_id, event_type AS name, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS count, round(sum(value), 2) AS ms, count(*)::BIGINT AS entries,
  (epoch_us(max(ts)) // 1000)::BIGINT AS last_at, CASE WHEN bool_or(value > 250) THEN 'error' WHEN bool_or(value > 1) THEN 'ok' ELSE 'skipped' END AS status FROM events GROUP BY ALL
""")
def run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return V.step_rollup(steps(spark, sf))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("count"),
        F.col("value").alias("ms"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("value") > 250, "error").when(F.col("value") > 1, "ok").otherwise("skipped").alias("status"),
    )


@query("run_listing", "V20", """
SELECT user_id AS run_id, round(min((epoch_us(ts) // 1000)) / 1e3, 3) AS started_at, CASE WHEN bool_or(event_type = 'purchase' AND value > 150) THEN round(max((epoch_us(ts) // 1000)) / 1e3, 3) END AS ended_at,
 NOT bool_or(event_type = 'purchase' AND value > 150) AS active,
 CASE WHEN bool_or(event_type = 'purchase' AND value > 150) THEN round(max((epoch_us(ts) // 1000)) / 1e3 - min((epoch_us(ts) // 1000)) / 1e3, 2) END AS duration_s FROM events GROUP BY 1
""")
def run_listing(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("s", F.unix_millis(F.col("ts").cast("timestamp")) / 1000)
    done = F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 150))
    g = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("s").alias("started_at"), F.when(done, F.max("s")).alias("ended_at"))
    return V.run_listing(g).select("run_id", F.round("started_at", 3).alias("started_at"), F.round("ended_at", 3).alias("ended_at"), "active", "duration_s")


@query("dataset_versions", "V11 V14", f"""
WITH {_SQL_STORE} SELECT 't1' AS tenant, 6::BIGINT AS version, 'ingest' AS reason, (SELECT count(*) FROM st)::BIGINT AS documents, (SELECT count(*) FROM st)::BIGINT AS passages
WHERE EXISTS (SELECT 1 FROM df WHERE status <> 'noop')
""")
def dataset_versions(spark: SparkSession, sf: str) -> DataFrame:
    st = store(spark, sf)
    changed = V.ingest_diff(incoming(spark, sf), st).where("status <> 'noop'").select("tenant", F.lit("ingest").alias("reason"))
    hist = table(spark, sf, "region").select(F.lit("t1").alias("tenant"), (F.col("r_regionkey") + 1).cast("long").alias("version"))
    p = st.select("tenant", F.lit(None).cast("string").alias("superseded_by"))
    return V.bump_dataset(hist, changed, st, p)


@query("ingest_batch", "V4 V1 V2 C3 G1 G5", f"""
WITH {_SQL_STORE}, lex AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part),
w AS (SELECT status, uri, list_filter(list_transform(string_split(text, e'\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM df WHERE status <> 'noop'),
u AS (SELECT status, uri, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM w), m AS (SELECT status, count(*) AS n FROM u, lex WHERE length(term) >= 3 AND contains(lower(t), term) GROUP BY 1)
SELECT w.status, count(*)::BIGINT AS records, sum(len(ps))::BIGINT AS passages, coalesce(any_value(m.n), 0)::BIGINT AS typed_mentions FROM w LEFT JOIN m USING (status) GROUP BY w.status
""")
def ingest_batch(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ingest import ingest_batch as batch
    from .graph import lexicon

    st = store(spark, sf)
    out = batch(incoming(spark, sf), st, passages_of(st, 1), lexicon(spark, sf), r"\n")
    key = out["status"].select("document_id", "status")
    p = out["new_passages"].groupBy("document_id").agg(F.count(F.lit(1)).alias("p"))
    m = out["mentions"].where("confidence = 0.9").groupBy("document_id").agg(F.count(F.lit(1)).alias("m"))
    j = key.where("status <> 'noop'").join(p, "document_id", "left").join(m, "document_id", "left")
    return j.groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.sum("p").alias("passages"), F.coalesce(F.sum("m"), F.lit(0)).alias("typed_mentions"))
