"""Sources and sinks: rows of the test tables are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sheets, vectors
from ..operators import versions as V
from ..registry import query
from ..session import table
from ..sources import files, records
from .events import scratch

_PRICES = [("m0", 3.0, 15.0, 0.3, 3.75), ("m1", 0.25, 1.25, 0.03, 0.3)]


@query("ledger_files", "S19 S20", """
WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 'answer_bake' WHEN 'click' THEN 'translate' ELSE 'unknown:' || event_type END AS purpose, user_id % 3 AS m, round(value)::BIGINT AS tin, user_id AS tout FROM events)
SELECT day, purpose, count(*)::BIGINT AS calls, sum(tin)::BIGINT AS input_tokens, round(sum(CASE m WHEN 0 THEN round(tin * 3e0 / 1e6 + tout * 15e0 / 1e6, 8) WHEN 1 THEN round(tin * 25e-2 / 1e6 + tout * 125e-2 / 1e6, 8) ELSE 0e0 END), 8) AS cost_usd
FROM c WHERE day >= '2024-01-15' GROUP BY ALL
""")
def ledger_files(spark: SparkSession, sf: str) -> DataFrame:
    """Events as priced calls, appended in two parts by day and read back from a day on."""
    e = table(spark, sf, "events")
    purpose = F.when(F.col("event_type") == "view", "answer_bake").when(F.col("event_type") == "click", "translate").otherwise(F.col("event_type"))
    calls = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), purpose.alias("purpose"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.round("value").cast("long").alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_input_tokens"), F.lit(0).cast("long").alias("cache_creation_input_tokens"),
    )
    prices = spark.createDataFrame(_PRICES, "model string, p_in double, p_out double, p_read double, p_write double")
    folder = f"{scratch(spark)}/ledger"
    for part in (calls.where("output_tokens % 2 = 0"), calls.where("output_tokens % 2 = 1")):
        files.append_ledger(part, prices, folder)
    r = files.read_ledger(spark, folder, "2024-01-15")
    g = r.groupBy(F.col("day").cast("string").alias("day"), "purpose")
    return g.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_usd"), 8).alias("cost_usd"))


@query("facts_merge", "S21", """
WITH old AS (SELECT p_brand AS repo, p_type AS fact, count(*) AS n FROM part GROUP BY ALL), new AS (SELECT p_brand AS repo, p_type AS fact, count(*) AS n FROM part WHERE p_size > 25 AND p_brand LIKE '%1' GROUP BY ALL)
SELECT repo, fact, n::BIGINT AS n FROM new UNION ALL SELECT repo, fact, n FROM old WHERE repo NOT IN (SELECT repo FROM new)
""")
def facts_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh facts of some repositories replace all their stored ones."""
    p = table(spark, sf, "part")
    facts = lambda d: d.groupBy(F.col("p_brand").alias("repo"), F.col("p_type").alias("fact")).agg(F.count(F.lit(1)).alias("n"))
    return files.merge_facts(facts(p), facts(p.where("p_size > 25 and p_brand like '%1'")), ["repo"])


@query("vector_upsert", "S23", """
SELECT 't' || vec_id % 2 AS tenant, vec_id AS passage_id, 'm' AS model_id, CASE WHEN label = 1 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END AS first FROM embeddings
UNION ALL SELECT 't' || (vec_id + 1) % 2, vec_id, 'm', -embedding[1]::DOUBLE FROM embeddings WHERE label = 2
""")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """New vectors replace stored ones of their tenant; those of the other tenant are added."""
    e = table(spark, sf, "embeddings")
    row = lambda d, shift, sign: d.select(F.concat(F.lit("t"), ((F.col("vec_id") + shift) % 2).cast("string")).alias("tenant"), F.col("vec_id").alias("passage_id"), F.lit("m").alias("model_id"), (sign * F.col("embedding")[0].cast("double")).alias("first"))
    fresh = row(e.where("label = 1"), 0, -1).unionByName(row(e.where("label = 2"), 1, -1))
    return vectors.keep_latest_vectors(row(e, 0, 1), fresh)


@query("sheet_files", "S4", """
WITH o AS (SELECT o_orderpriority AS p, [o_orderkey::VARCHAR, 'one, "two"' || chr(10) || o_orderpriority, o_orderstatus] AS cells FROM orders)
SELECT 'p=' || p AS sheet, count(*)::BIGINT AS rows, sum(cells[1]::BIGINT)::BIGINT AS keys, min(len(cells))::INTEGER AS width, bool_and(cells[2] = 'one, "two"' || chr(10) || p) AS whole FROM o GROUP BY 1, p
""")
def sheet_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as delimited files with quoted separators and line breaks, read back as cells."""
    o = table(spark, sf, "orders")
    folder = f"{scratch(spark)}/sheets"
    text = F.concat(F.lit('one, "two"\n'), "o_orderpriority")
    out = o.select("o_orderpriority", F.col("o_orderkey").cast("string").alias("k"), text.alias("t"), "o_orderstatus")
    out.withColumn("p", F.col("o_orderpriority")).drop("o_orderpriority").write.partitionBy("p").option("escape", '"').csv(folder)
    got = files.delimited_sheets(spark, f"{folder}/*/*.csv")
    kind = F.substring(F.element_at(F.split(F.col("cells")[1], "\n"), -1), 1, 99)
    g = got.groupBy(F.concat(F.lit("p="), kind).alias("sheet"), kind.alias("_k"))
    return g.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("cells")[0].cast("long")).alias("keys"), F.min(F.size("cells")).alias("width"), F.bool_and(F.col("cells")[1] == F.concat(F.lit('one, "two"\n'), kind)).alias("whole"),
    ).drop("_k")


@query("dropped_files", "S1", """
SELECT 't1' AS tenant, 'text/plain' AS mime, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS body FROM nation GROUP BY n_regionkey
""")
def dropped_files(spark: SparkSession, sf: str) -> DataFrame:
    """The nations of each region as one text file in a folder of its own, scanned as dropped files."""
    n = table(spark, sf, "nation")
    folder = f"{scratch(spark)}/drop"
    one = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    one.repartition("n_regionkey").write.partitionBy("n_regionkey").text(folder)
    got = files.drop_folder(spark, folder, "t1").where(F.element_at("meta", "path").endswith(".txt"))
    return got.select("tenant", "mime", F.sha2("body", 256).alias("body"))


@query("website_pages", "S16", r"""
SELECT 'website' AS source, 'text/html' AS mime, page_id AS id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?\S.*?</title>') THEN trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) ELSE url END AS title, 'v1' AS source_version, length(html)::INTEGER AS n FROM pages
""")
def website_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    w = records.website_records(p.withColumn("html", F.col("html")), "v1")
    ids = p.select("page_id", records.canonical_url(F.col("url")).alias("uri"), F.col("html").alias("body"))
    return w.join(ids, ["uri", "body"]).select("source", "mime", F.col("page_id").alias("id"), "title", "source_version", F.length("body").alias("n"))


@query("table_describe", "C21", """
SELECT 'o_orderkey' AS name, 'bigint' AS type, (SELECT count(*) FROM orders)::BIGINT AS rows UNION ALL SELECT 'o_custkey', 'bigint', (SELECT count(*) FROM orders) UNION ALL SELECT 'o_orderstatus', 'string', (SELECT count(*) FROM orders)
UNION ALL SELECT 'o_totalprice', 'double', (SELECT count(*) FROM orders) UNION ALL SELECT 'o_orderdate', 'timestamp', (SELECT count(*) FROM orders) UNION ALL SELECT 'o_orderpriority', 'string', (SELECT count(*) FROM orders)
""")
def table_describe(spark: SparkSession, sf: str) -> DataFrame:
    columns, rows, _ = sheets.describe(table(spark, sf, "orders"))
    kinds = [(n, "timestamp" if t.startswith("timestamp") else t) for n, t in columns]
    return spark.createDataFrame(kinds, "name string, type string").crossJoin(rows)


@query("ledger_backfill", "V7", """
WITH p AS (SELECT user_id AS document_id, event_type AS version, count(*) AS passages, min(event_id) AS first FROM events GROUP BY ALL) SELECT document_id, version, passages::BIGINT AS passages, first FROM p WHERE version <> 'view'
""")
def ledger_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Versions that only the passage table knows; those of one kind are in the ledger already."""
    e = table(spark, sf, "events")
    p = e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("version"), F.col("event_id").alias("pos"), F.col("event_id").alias("passage_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("content_hash"), F.lit("1").alias("source_version"))
    known, _ = V.record_versions(p.where("version = 'view'"))
    return V.backfill(known, p).select("document_id", "version", "passages", F.col("content_hash").cast("long").alias("first"))


@query("dataset_list", "V12", """
SELECT user_id % 7 AS tenant_no, event_id AS version FROM events WHERE user_id % 7 = 3 ORDER BY event_id DESC
""")
def dataset_list(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").select((F.col("user_id") % 7).alias("tenant_no"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant"), F.col("event_id").alias("version"))
    return V.list_dataset_versions(h, "t3").select("tenant_no", "version")
