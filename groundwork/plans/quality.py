"""Quality, curation and evaluation queries.

A document's passages are its lines; it is read as a whole for readability. Answer spans (events) cite passages by document id and titles by
source name; stored vectors give duplicates; labels give contradictions and curator marks; benchmark
items are the open gap questions; the age in days is derived from the length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import evaluate as E
from ..operators import quality as Q
from ..operators import vectors
from ..operators.extract import lexicon_mentions
from ..registry import query
from ..session import table, wide_table
from .common import documents, embeddings
from .graph import _LEX, lexicon

VOCAB = "with ering nder that die der que les para una".split()
_STOPS = "('" + "','".join([*Q.STOP_WORDS, "according"]) + "')"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("document_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("trim(text) <> ''")
    return d.withColumn("passage_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("pos").cast("string")))


_LINES = r"ln AS (SELECT doc_id, pos, text FROM (SELECT doc_id, unnest(string_split(text, e'\n')) AS text, generate_subscripts(string_split(text, e'\n'), 1) - 1 AS pos FROM documents) WHERE trim(text) <> '')"
_READ = r"""rd AS (SELECT *, len(w) AS nw, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+(\s+|$)|\n+'), lambda s: regexp_matches(s, '[A-Za-z0-9_'']+')))) AS ns, len(list_filter(w, lambda x: length(x) >= 8)) AS nl
  FROM (SELECT doc_id, pos, text, regexp_extract_all(text, '[A-Za-z0-9_'']+') AS w FROM ln)),
rs AS (SELECT doc_id, pos, CASE WHEN nw = 0 THEN 0e0 ELSE round(least(1e0, greatest(0e0, 1e0 - 6e-1 * least(1e0, greatest(0e0, (nw / ns - 15e0) / 3e1)) - 4e-1 * least(1e0, nl / nw / 6e-1))), 4) END AS r FROM rd)"""


@query("readability", "Q2", f"WITH {_LINES}, {_READ} SELECT doc_id AS document_id, pos::INTEGER AS pos, r AS readability FROM rs")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("document_id", "pos", Q.readability(F.col("text")).alias("readability"))


_CITE = """
cv AS (SELECT event_id AS trace_id, json_extract_string(props, '$.k')::BIGINT AS k, 'src' || (user_id % 40) AS title FROM events WHERE event_type IN ('view', 'click', 'purchase')),
ct AS (SELECT * FROM cv WHERE k // 25 > 0),
fp AS (SELECT DISTINCT trace_id, doc_id, source FROM ct JOIN documents ON doc_id = k),
own AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
tt AS (SELECT trace_id, d.doc_id FROM ct JOIN own ON own.source = ct.title JOIN documents d ON d.source = ct.title
  WHERE own.n = 1 OR NOT EXISTS (SELECT 1 FROM fp WHERE fp.trace_id = ct.trace_id AND fp.source = ct.title)),
us AS (SELECT doc_id, count(DISTINCT trace_id) AS uses FROM (SELECT trace_id, doc_id FROM fp UNION ALL SELECT * FROM tt) GROUP BY 1)"""


def usage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase")).withColumn("k", F.get_json_object("props", "$.k").cast("long")).where("k div 25 > 0")
    pc = e.select(F.col("event_id").alias("trace_id"), F.col("k").alias("passage_id"))
    tc = e.select(F.col("event_id").alias("trace_id"), F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string")).alias("title"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    return Q.citation_usage(pc, tc, d.select("document_id", F.col("document_id").alias("passage_id")), d)


@query("citation_usage", "Q1 J3", f"WITH {_CITE} SELECT doc_id AS document_id, uses::BIGINT AS uses FROM us")
def citation_usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage(spark, sf)


_GAP = f"""
gq AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
gt AS (SELECT * FROM gq WHERE length(token) > 2 AND token NOT IN {_STOPS}),
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
gh AS (SELECT doc_id, count(*) AS gap_hits FROM (SELECT doc_id, item_id FROM dt JOIN gt USING (token) GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1)"""


@query("gap_hits", "Q5", f"WITH {_GAP} SELECT doc_id AS document_id, gap_hits::BIGINT AS gap_hits FROM gh")
def gap_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_hits(spark, sf)


def _gap_hits(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "benchmark").select(F.col("item_id").alias("gap_id"), "text")
    return Q.gap_hits(g, documents(spark, sf).select("document_id", F.lit("").alias("title"), "text"))


_ORPH = f"""{_LINES}, {_LEX}, mn AS (SELECT DISTINCT doc_id, pos FROM ln, lex WHERE contains(lower(ln.text), term)),
orp AS (SELECT l.doc_id, l.n, CASE WHEN m.c IS NULL THEN 1e0 ELSE round(1e0 - m.c / l.n::DOUBLE, 4) END AS orphan_ratio FROM (SELECT doc_id, count(*) AS n FROM ln GROUP BY 1) l LEFT JOIN (SELECT doc_id, count(*) AS c FROM mn GROUP BY 1) m USING (doc_id))"""


@query("orphan_ratio", "Q4", f"WITH {_ORPH} SELECT doc_id AS document_id, orphan_ratio FROM orp")
def orphan_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    ln = lines(spark, sf)
    m = lexicon_mentions(ln, lexicon(spark, sf)).select("passage_id").distinct()
    m = m.withColumn("document_id", F.element_at(F.split("passage_id", ":"), 1).cast("long"))
    return Q.orphan_ratio(ln, m)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    # a document is as readable as its passages are on average; four-place parts are summed as whole numbers
    parts = lines(spark, sf).select("document_id", F.round(10000 * Q.readability(F.col("text"))).cast("long").alias("r"))
    read = parts.groupBy("document_id").agg(F.count(F.lit(1)).alias("passages"), F.sum("r").alias("_r"))
    read = read.select("document_id", "passages", (F.expr("(2 * _r + passages) div (2 * passages)") / 10000).alias("readability"))
    dup = vectors.near_duplicates(embeddings(spark, sf), 0.45).withColumn("document_id", F.expr("id div 4"))
    dup = dup.groupBy("document_id").agg(F.count_if(F.col("originals") > 0).alias("duplicate_passages"), F.count_if(F.col("copies") > 0).alias("duplicated_by"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.col("toxic").cast("long").alias("contradiction_flags"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("authoritative"))
    s = d.select("document_id", "source", (F.col("n_chars") % 800).cast("double").alias("age_days"), Q.coverage(d, VOCAB).alias("coverage"))
    for other in (read, usage(spark, sf).withColumnRenamed("uses", "citation_uses"), dup, lab, _orphans(spark, sf), _gap_hits(spark, sf)):
        s = s.join(other, "document_id", "left")
    s = s.fillna(0, ["passages", "citation_uses", "duplicate_passages", "duplicated_by", "contradiction_flags", "gap_hits"]).fillna(0.0, ["readability"])
    s = s.withColumn("authoritative", F.coalesce("authoritative", F.lit(False))).withColumn("orphan_ratio", F.coalesce("orphan_ratio", F.lit(1.0)))
    # more places than reported: sums of four-place parts then have no ties for two engines to break
    return Q.suggest(Q.quality_score(s, places=12))


_VOC = "[" + ",".join(f"'{v}'" for v in VOCAB) + "]"
_SIG = f"""{_ORPH}, {_READ}, {_CITE}, {_GAP},
rr AS (SELECT doc_id, (2 * sum(round(10000 * r)::BIGINT) + count(*)) // (2 * count(*)) / 1e4 AS readability FROM rs GROUP BY 1),
v AS (SELECT vec_id AS id, vec_id // 4 AS document_id, embedding::DOUBLE[] AS vec FROM embeddings),
pp AS (SELECT a.id, a.document_id AS da, b.document_id AS db FROM v a JOIN v b ON a.document_id <> b.document_id WHERE list_dot_product(a.vec, b.vec) >= 45e-2),
dp AS (SELECT da AS doc_id, count(DISTINCT id) FILTER (db < da) AS dups, count(DISTINCT id) FILTER (db > da) AS dby FROM pp GROUP BY 1),
sg AS (SELECT d.doc_id AS document_id, d.source, (d.n_chars % 800)::DOUBLE AS age_days,
  round(len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')), lambda t: length(t) > 2 AND t NOT IN {_STOPS}), {_VOC})) / {len(VOCAB)}e0, 4) AS coverage,
  coalesce(rr.readability, 0e0) AS readability, coalesce(orp.n, 0) AS passages, coalesce(us.uses, 0) AS citation_uses, coalesce(dp.dups, 0) AS duplicate_passages, coalesce(dp.dby, 0) AS duplicated_by,
  coalesce(l.toxic, 0) AS contradiction_flags, coalesce(l.quality = 1 AND l.toxic = 0, FALSE) AS authoritative, coalesce(orp.orphan_ratio, 1e0) AS orphan_ratio, coalesce(gh.gap_hits, 0) AS gap_hits
 FROM documents d LEFT JOIN rr USING (doc_id) LEFT JOIN orp USING (doc_id) LEFT JOIN us USING (doc_id) LEFT JOIN dp USING (doc_id) LEFT JOIN labels l USING (doc_id) LEFT JOIN gh USING (doc_id)),
sc AS (SELECT *, CASE WHEN passages > 0 THEN duplicate_passages / passages ELSE 0e0 END AS share, round(least(1e0, greatest(0e0, 25e-2 * least(1e0, citation_uses / 3e0) + 15e-2 * (1e0 - least(1e0, age_days / 365)) + 2e-1 * (1e0 - CASE WHEN passages > 0 THEN duplicate_passages / passages ELSE 1e0 END)
  + 1e-1 * (contradiction_flags = 0)::INTEGER + 1e-1 * readability + 1e-1 * coverage + 1e-1 * (1e0 - orphan_ratio) + CASE WHEN authoritative THEN 1e-1 ELSE 0e0 END)), 12) AS score FROM sg),
sk AS (SELECT *, (passages > 0 AND share >= 5e-1) AS dupd, (age_days > 365 AND citation_uses = 0) AS stale FROM sc),
qq AS (SELECT *, CASE WHEN (dupd OR stale) AND authoritative THEN 'review' WHEN dupd OR stale THEN 'delete' WHEN citation_uses = 0 OR readability < 35e-2 OR contradiction_flags > 0 THEN 'review' ELSE 'keep' END AS suggestion FROM sk)"""


@query("quality_score", "Q6 Q8 Q1 Q4 Q5", f"""
WITH {_SIG} SELECT document_id, source, readability, coverage, passages::BIGINT AS passages, citation_uses::BIGINT AS citation_uses, duplicate_passages::BIGINT AS duplicate_passages,
 duplicated_by::BIGINT AS duplicated_by, orphan_ratio, gap_hits::BIGINT AS gap_hits, score FROM qq
""")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return signals(spark, sf).select("document_id", "source", "readability", "coverage", "passages", "citation_uses", "duplicate_passages", "duplicated_by", "orphan_ratio", "gap_hits", "score")


@query("quality_suggest", "Q7 Q8", f"""
WITH {_SIG} SELECT document_id, score, suggestion, CASE WHEN len(rs2) = 0 AND suggestion = 'keep' THEN 'cited, readable, unique and consistent' ELSE array_to_string(rs2, '; ') END AS reasons FROM (
SELECT *, list_filter([CASE WHEN dupd THEN 'duplicate' END, CASE WHEN stale THEN 'stale and unused' END, CASE WHEN citation_uses = 0 THEN 'never cited' END, CASE WHEN readability < 35e-2 THEN 'low readability' END,
 CASE WHEN contradiction_flags > 0 THEN 'contradictions' END, CASE WHEN duplicate_passages > 0 AND NOT (dupd OR stale) THEN 'some duplicate passages' END, CASE WHEN duplicated_by > 0 THEN 'original of newer copies' END,
 CASE WHEN gap_hits > 0 THEN 'near unanswered questions' END, CASE WHEN (dupd OR stale) AND authoritative THEN 'authoritative' END], lambda x: x IS NOT NULL) AS rs2 FROM qq)
""")
def quality_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return Q.worst_first(signals(spark, sf)).select("document_id", "score", "suggestion", F.array_join("reasons", "; ").alias("reasons"))


@query("quality_rollup", "Q9", f"""
WITH {_SIG}, g AS (SELECT count(*)::BIGINT AS documents, sum(passages)::BIGINT AS passages, sum(duplicate_passages) AS d, count(*) FILTER (citation_uses > 0) AS c, round(sum(readability) / count(*), 4) AS readability_avg,
 (count(*) FILTER (suggestion = 'keep'))::BIGINT AS n_keep, (count(*) FILTER (suggestion = 'review'))::BIGINT AS n_review, (count(*) FILTER (suggestion = 'delete'))::BIGINT AS n_delete FROM qq),
h AS (SELECT *, round(d / passages::DOUBLE, 4) AS duplicate_rate, round(c / documents::DOUBLE, 4) AS citation_coverage FROM g)
SELECT documents, passages, readability_avg, n_keep, n_review, n_delete, duplicate_rate, citation_coverage, array_to_string(list_filter([CASE WHEN duplicate_rate >= 25e-2 THEN 'duplicate content:high' WHEN duplicate_rate > 0 THEN 'duplicate content:medium' END,
 CASE WHEN n_delete > 0 THEN 'documents suggested for deletion:medium' END, CASE WHEN citation_coverage < 5e-1 THEN 'most documents never cited:medium' END, CASE WHEN readability_avg < 35e-2 THEN 'low readability:low' END], lambda x: x IS NOT NULL), '; ') AS risks FROM h
""")
def quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_rollup(signals(spark, sf))


@query("curation_score", "Q13", f"""
WITH {_SIG}, d AS (SELECT *, round(1e0 - least(1e0, age_days / 365), 4) AS currency, CASE WHEN passages > 0 THEN round(duplicate_passages / passages, 4) ELSE 0e0 END AS duplicate_pct, round(1e0 - orphan_ratio, 4) AS connectedness,
 round(least(1e0, 6e-1 * least(1e0, passages / 8e0) + 4e-1 * coverage), 4) AS depth, CASE WHEN passages > 0 THEN 1e0 ELSE 0e0 END AS traceability FROM qq),
o AS (SELECT *, round(least(1e0, greatest(0e0, 18e-2 * depth + 15e-2 * connectedness + 12e-2 * traceability + 15e-2 * readability + 15e-2 * currency + 15e-2 * (1e0 - duplicate_pct) + 1e-1 * CASE WHEN contradiction_flags > 0 THEN 0e0 ELSE 1e0 END)), 12) AS overall FROM d)
SELECT document_id, depth, currency, connectedness, round(overall, 10) AS overall, CASE WHEN duplicate_pct >= 5e-1 OR overall < 35e-2 THEN 'Delete' ELSE 'Keep' END AS recommendation FROM o
""")
def curation_score(spark: SparkSession, sf: str) -> DataFrame:
    return C.curation_score(signals(spark, sf), places=12).select("document_id", "depth", "currency", "connectedness", F.round("overall", 10).alias("overall"), "recommendation")


@query("health_snapshot", "Q10 G10 A21", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents), voc AS (SELECT unnest({_VOC}) AS t),
c AS (SELECT (SELECT count(*) FROM w WHERE t IN (SELECT t FROM voc)) AS covered, (SELECT count(*) FROM documents) AS passages, (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM nation) AS edges,
 (SELECT count(*) FROM nation WHERE n_regionkey = 3) AS contradictions, (SELECT count(*) FROM benchmark) AS gaps)
SELECT round(covered / {len(VOCAB)}e0, 6) AS coverage, round(least(1e0, edges / nodes::DOUBLE), 6) AS connectedness, 1e0 AS traceability, contradictions::BIGINT AS contradictions, gaps::BIGINT AS gaps, passages::BIGINT AS passages, nodes::BIGINT AS nodes, edges::BIGINT AS edges FROM c
""")
def health_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot(spark, sf)


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.createDataFrame([(x,) for x in VOCAB], "term string")
    return Q.health_snapshot(documents(spark, sf), table(spark, sf, "supplier"), table(spark, sf, "nation").withColumn("conflict", F.col("n_regionkey") == 3), table(spark, sf, "benchmark"), v)


@query("risk_register", "Q11", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents), c AS (SELECT (SELECT count(*) FROM w WHERE list_contains({_VOC}, t)) / {len(VOCAB)}e0 AS cov, least(1e0, (SELECT count(*) FROM nation) / (SELECT count(*) FROM supplier)::DOUBLE) AS conn)
SELECT 'thin coverage' AS risk, round(cov, 2) AS value, 'high' AS severity FROM c WHERE cov < 5e-1
UNION ALL SELECT 'contradictions flagged', count(*)::DOUBLE, 'high' FROM nation WHERE n_regionkey = 3 HAVING count(*) > 0
UNION ALL SELECT 'sparse graph / orphan nodes', round(conn, 2), 'medium' FROM c WHERE conn < 3e-1
UNION ALL SELECT 'unanswered demand (gap backlog)', count(*)::DOUBLE, 'medium' FROM benchmark HAVING count(*) > 0
""")
def risk_register(spark: SparkSession, sf: str) -> DataFrame:
    return Q.risk_register(_snapshot(spark, sf))


# Curation log: label rows are decisions, events of the matching document id add history.
_LOG = """
lg AS (SELECT 'r' || (json_extract_string(props, '$.k')::BIGINT * 10 + user_id % 10) AS review_id, json_extract_string(props, '$.k')::BIGINT * 10 + user_id % 10 AS document_id, event_id AS seq, ts AS at_,
 CASE event_type WHEN 'view' THEN 'ingested' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'deleted' ELSE 'auto_kept' END AS action, 'src' || (user_id % 20) AS source, CASE WHEN value > 50 THEN 'manual' ELSE 'automated' END AS mode FROM events)"""


def curation_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    doc = F.get_json_object("props", "$.k").cast("long") * 10 + F.col("user_id") % 10
    act = F.when(F.col("event_type") == "view", "ingested").when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "deleted").otherwise("auto_kept")
    return e.select(
        F.concat(F.lit("r"), doc.cast("string")).alias("review_id"), doc.alias("document_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        act.alias("action"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), F.when(F.col("value") > 50, "manual").otherwise("automated").alias("mode"),
    )


@query("review_queue", "Q17", f"""
WITH {_LOG}, la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY at_ DESC, seq DESC) = 1)
SELECT review_id, la.document_id, epoch_us(at_) AS ts, n_chars AS overall FROM la JOIN documents ON doc_id = la.document_id WHERE action = 'ingested'
""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("overall"))
    return C.review_queue(curation_log(spark, sf), scores).select("review_id", "document_id", "ts", "overall")


@query("curation_timeline", "Q18", f"""
WITH {_LOG}, m AS (SELECT unnest(range(1, 13))::INTEGER AS month), c AS (SELECT month(at_)::INTEGER AS month, count(*) FILTER (action = 'ingested') AS ingested, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'rejected') AS rejected,
 count(*) FILTER (action = 'deleted') AS deleted, count(*) FILTER (action = 'auto_kept') AS auto_kept FROM lg WHERE year(at_) = 2024 AND mode = 'manual' GROUP BY 1)
SELECT month, coalesce(ingested, 0)::BIGINT AS ingested, coalesce(accepted, 0)::BIGINT AS accepted, coalesce(rejected, 0)::BIGINT AS rejected, coalesce(deleted, 0)::BIGINT AS deleted, coalesce(auto_kept, 0)::BIGINT AS auto_kept FROM m LEFT JOIN c USING (month)
""")
def curation_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return C.timeline(curation_log(spark, sf), 2024, mode="manual")


@query("curation_modes", "Q12", """
WITH s AS (SELECT DISTINCT source FROM documents), st AS (SELECT source, max(CASE WHEN lang = 'fr' THEN 'manual' ELSE 'automated' END) AS m FROM documents WHERE lang IN ('fr', 'es') GROUP BY 1)
SELECT source, coalesce(m, 'manual') AS mode FROM s LEFT JOIN st USING (source)
""")
def curation_modes(spark: SparkSession, sf: str) -> DataFrame:
    return _modes(spark, sf)


def _modes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    st = d.where("lang in ('fr', 'es')").groupBy("source").agg(F.max(F.when(F.col("lang") == "fr", "manual").otherwise("automated")).alias("mode"))
    st = st.unionByName(spark.createDataFrame([(C.GLOBAL, "manual")], "source string, mode string"))
    return C.resolve_mode(d.select("source").distinct(), st)


@query("settle_ingested", "Q15 Q14", rf"""
WITH {_LOG}, la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY at_ DESC, seq DESC) = 1),
md AS (SELECT source, max(CASE WHEN lang = 'fr' THEN 'manual' ELSE 'automated' END) AS m FROM documents WHERE lang IN ('fr', 'es') GROUP BY 1),
j AS (SELECT d.doc_id, coalesce(m, 'manual') AS mode, action, substr(sha256('text/plain' || chr(0) || trim(regexp_replace(lower(d.source || ' ' || d.lang), '\s+', ' ', 'g'))), 1, 16) AS stable_id FROM documents d LEFT JOIN md USING (source) LEFT JOIN la ON la.review_id = 'r' || d.doc_id)
SELECT doc_id AS document_id, stable_id, CASE WHEN mode <> 'manual' THEN 'live' WHEN action = 'accepted' THEN 'live' WHEN action = 'rejected' THEN 'rejected' WHEN action = 'deleted' THEN 'deleted' ELSE 'review' END AS state,
 CASE WHEN mode = 'manual' AND (action IS NULL OR action NOT IN ('accepted', 'rejected', 'deleted')) THEN 'ingested' END AS log_action FROM j
""")
def settle_ingested(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), "source", F.lit("ok").alias("status"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("review_id"),
        C.review_id(F.lit("text/plain"), F.concat_ws(" ", "source", "lang")).alias("stable_id"),
    )
    return C.settle(d, _modes(spark, sf), curation_log(spark, sf)).select("document_id", "stable_id", "state", "log_action")


@query("curator_decisions", "Q16 Q30", f"""
WITH {_LOG}, dc AS (SELECT document_id, at_, seq, CASE action WHEN 'ingested' THEN 'authoritative' WHEN 'accepted' THEN 'accept' WHEN 'rejected' THEN 'reject' WHEN 'deleted' THEN 'delete' ELSE 'not_authoritative' END AS d FROM lg),
s AS (SELECT document_id, d FROM dc WHERE d IN ('accept', 'reject', 'delete') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY at_ DESC, seq DESC) = 1),
f AS (SELECT document_id, d FROM dc WHERE d IN ('authoritative', 'not_authoritative') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY at_ DESC, seq DESC) = 1)
SELECT doc_id AS document_id, CASE s.d WHEN 'accept' THEN 'live' WHEN 'reject' THEN 'rejected' WHEN 'delete' THEN 'deleted' ELSE 'review' END AS state, coalesce(f.d = 'authoritative', FALSE) AS authoritative
FROM documents LEFT JOIN s ON s.document_id = doc_id LEFT JOIN f ON f.document_id = doc_id
""")
def curator_decisions(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("action")
    d = F.when(a == "ingested", "authoritative").when(a == "accepted", "accept").when(a == "rejected", "reject").when(a == "deleted", "delete").otherwise("not_authoritative")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit("review").alias("state"), F.lit(False).alias("authoritative"))
    return C.apply_decisions(docs, curation_log(spark, sf).select("document_id", d.alias("decision"), "ts", "seq"))


@query("feedback_rate", "Q31", """
WITH a AS (SELECT event_type AS level, count(*) AS n, count(*) FILTER (value > 100) AS f FROM events GROUP BY 1) SELECT level, n::BIGINT AS answered, f::BIGINT AS flagged, round(f / n::DOUBLE, 4) AS rate FROM a
""")
def feedback_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("event_type", "level")
    return C.feedback_rate(e.where("value > 100"), e)


@query("negative_feedback", "Q31", """
WITH u AS (SELECT conv_id, turn, text, lead(text) OVER w AS answer, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(substr(answer, 1, 2000)) AS answer_md5, len(list_filter([p1, p2], lambda x: x IS NOT NULL))::INTEGER AS context_turns, substr(p1, 1, 400) AS last_turn FROM u WHERE answer IS NOT NULL
""")
def negative_feedback(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turn = lambda n: F.when(F.lag("text", n).over(w).isNotNull(), F.struct(F.lag("text", n).over(w).alias("q"), F.lit("").alias("a")))
    c = wide_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lead("text").over(w).alias("answer"), F.array_compact(F.array(turn(1), turn(2))).alias("context"),
        F.array(F.struct(F.col("role").alias("title"), F.col("text").alias("snippet"))).alias("citations"),
    ).where("answer is not null")
    t = C.trim_feedback(c)
    return t.select("conv_id", "turn", F.md5("answer").alias("answer_md5"), F.size("context").alias("context_turns"), F.try_element_at("context", F.lit(1))["q"].alias("last_turn"))


# ---- evaluation ---------------------------------------------------------------------------
def bank_expected(spark: SparkSession, sf: str) -> DataFrame:
    """Expected documents of a banked question: those holding the item's text, found on its first 3-gram."""
    from ..operators.retrieval import contains_join

    b = table(spark, sf, "benchmark").select("item_id", F.substring_index("text", ".", 1).alias("needle")).where("length(needle) >= 3")
    return contains_join(b, "needle", documents(spark, sf).select("doc_id", "text", "source"), "text").select("item_id", "doc_id", "source")


_BANK = """
ex AS (SELECT item_id, doc_id, source FROM benchmark b JOIN documents d ON contains(d.text, string_split(b.text, '.')[1]) WHERE length(string_split(b.text, '.')[1]) >= 3),
an AS (SELECT item_id, count(ex.doc_id) AS n_cites, count(ex.doc_id) FILTER (source <> 'src3') AS good, length(b.text) AS len FROM benchmark b LEFT JOIN ex USING (item_id) GROUP BY item_id, b.text),
mt AS (SELECT count(*)::BIGINT AS n, round(count(*) FILTER (n_cites > 0) / count(*)::DOUBLE, 4) AS citation_coverage, round(count(*) FILTER (n_cites > 0 AND good > 0) / count(*)::DOUBLE, 4) AS answer_supportedness,
 round(count(*) FILTER (least(1e0, len / 3e2) >= 5e-1) / count(*)::DOUBLE, 4) AS grounding_pass_rate, (SELECT CASE WHEN count(*) > 0 THEN round(count(*) FILTER (source NOT IN ('src4','src9','src14','src19')) / count(*)::DOUBLE, 4) ELSE 0e0 END FROM ex) AS recall FROM an)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    from .common import RESTRICTED
    from ..session import cut_lineage

    ex = cut_lineage(bank_expected(spark, sf))
    b = table(spark, sf, "benchmark")
    a = ex.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_cites"), F.count_if(F.col("source") != "src3").alias("good"))
    a = b.join(a, "item_id", "left").fillna(0, ["n_cites", "good"]).select(
        F.col("item_id").alias("question_id"), F.when(F.col("n_cites") > 0, "answer").otherwise("gap").alias("kind"), F.least(F.lit(1.0), F.length("text") / 300.0).alias("grounding"), "n_cites", (F.col("good") > 0).alias("resolvable"),
    )
    return E.bank_metrics(a, ex.select(F.col("item_id").alias("question_id"), F.col("doc_id").alias("document_id"), (~F.col("source").isin(*RESTRICTED)).alias("cited")), 0.5)


@query("bank_recall", "Q20", f"WITH {_BANK} SELECT * FROM mt")
def bank_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query("promotion_gate", "Q21", f"""
WITH {_BANK}, x AS (SELECT unnest(['citation_coverage', 'grounding_pass_rate', 'answer_supportedness', 'recall']) AS m, unnest([citation_coverage, grounding_pass_rate, answer_supportedness, recall]) AS v, unnest([75e-2, 6e-1, 75e-2, 5e-1]) AS f FROM mt)
SELECT bool_and(v >= f) AS passed, coalesce(string_agg(m, ',' ORDER BY m) FILTER (v < f), '') AS regressions FROM x
""")
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    return E.promotion_gate(_metrics(spark, sf))


@query("bank_candidates", "Q19", """
WITH t AS (SELECT p_partkey AS id, array_to_string(list_filter(regexp_split_to_array(trim(p_brand || ' overview of ' || p_name), '[\\s/_-]+'), lambda w: w <> '' AND lower(w) NOT IN ('product','products','service','services','overview','document','policy','guide','company','the','a','an','of','and','for')), ' ') AS s FROM part),
o AS (SELECT lower(s) AS k, arg_min(s, id) AS s FROM t GROUP BY 1)
SELECT 'definition' AS family, 'what is ' || s || '?' AS question FROM o UNION ALL SELECT 'coverage', 'what does ' || s || ' cover?' FROM o
""")
def bank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), F.concat_ws(" ", F.concat(F.lpad((F.col("p_size")).cast("string"), 2, "0"), F.lit("-"), "p_brand"), F.lit("overview of"), "p_name").alias("title"))
    return E.bank_candidates(p)


@query("graded_answers", "Q22 Q23", """
WITH g AS (SELECT o_orderpriority AS set, o_orderkey, 'There are ' || o_custkey || ' items, total ' || (o_custkey + 1) || '.50 in state ' || o_orderstatus AS answer, (o_custkey + CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 0 END) AS e, o_orderstatus <> 'O' AS cited FROM orders),
k AS (SELECT *, list_contains(list_transform(regexp_extract_all(answer, '\\d[\\d,]*\\.?\\d*'), lambda x: replace(x, ',', '')::DOUBLE), e::DOUBLE) AS ok FROM g)
SELECT set, count(*)::BIGINT AS n, (count(*) FILTER (ok))::BIGINT AS passed, round(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS accuracy, round(count(*) FILTER (cited) / count(*)::DOUBLE, 4) AS citation_rate,
 round(count(*) FILTER (NOT ok) / count(*)::DOUBLE, 4) AS false_answer_rate FROM k GROUP BY set
""")
def graded_answers(spark: SparkSession, sf: str) -> DataFrame:
    return E.set_metrics(_graded(spark, sf))


@query("set_gates", "Q23", """
WITH g AS (SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS c, o_orderstatus <> 'P' OR list_contains([(o_custkey + 1) + 0.5], o_custkey + 5e0) AS ok, o_orderstatus <> 'O' AS cited FROM orders),
r AS (SELECT round((count(*) FILTER (c AND ok)) / (count(*) FILTER (c))::DOUBLE, 4) AS exact_count_accuracy, round((count(*) FILTER (c AND NOT ok)) / (count(*) FILTER (c))::DOUBLE, 4) AS false_answer_rate, round(avg(cited::INT), 4) AS citation_rate FROM g)
SELECT *, concat_ws(',', CASE WHEN false_answer_rate > 0 THEN 'false_answer_rate' END, CASE WHEN exact_count_accuracy < 1 THEN 'exact_count_accuracy' END, CASE WHEN citation_rate < 95e-2 THEN 'citation_rate' END) AS gate_failures FROM r
""")
def set_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Gates over all sets; urgent and high orders are the counted ones."""
    return E.set_gates(_graded(spark, sf), ("1-URGENT", "2-HIGH"))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    g = o.select(
        F.col("o_orderpriority").alias("set"), F.concat(F.lit("There are "), F.col("o_custkey").cast("string"), F.lit(" items, total "), (F.col("o_custkey") + 1).cast("string"), F.lit(".50 in state "), "o_orderstatus").alias("answer"),
        (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 5).otherwise(0)).cast("double").alias("expect_number"), F.lit(None).cast("array<string>").alias("expect_list"), F.lit(None).cast("string").alias("expect_text"),
        F.lit(True).alias("answered"), (F.col("o_orderstatus") != "O").alias("cited"), F.col("o_orderstatus").alias("audience"),
    )
    return E.grade(g)


@query("coverage_matrix", "Q24", """
WITH g AS (SELECT o_orderpriority AS data_type, o_orderstatus AS audience, (o_custkey + CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 0 END) AS e, 'There are ' || o_custkey || ' items, total ' || (o_custkey + 1) || '.50 in state ' || o_orderstatus AS answer FROM orders),
k AS (SELECT *, list_contains(list_transform(regexp_extract_all(answer, '\\d[\\d,]*\\.?\\d*'), lambda x: replace(x, ',', '')::DOUBLE), e::DOUBLE) AS ok FROM g),
c AS (SELECT data_type, audience FROM (SELECT DISTINCT o_orderpriority AS data_type FROM orders), (SELECT unnest(['F', 'O', 'P', 'X']) AS audience)),
a AS (SELECT data_type, audience, count(*) AS n, count(*) FILTER (ok) AS p FROM k GROUP BY ALL)
SELECT data_type, audience, coalesce(n, 0)::BIGINT AS n, CASE WHEN data_type = '5-LOW' THEN 0 ELSE coalesce(p, 0) END::BIGINT AS passed, CASE WHEN data_type = '5-LOW' OR coalesce(n, 0) = 0 THEN 'na' WHEN p = n THEN 'green' WHEN p = 0 THEN 'coral' ELSE 'amber' END AS status FROM c LEFT JOIN a USING (data_type, audience)
""")
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    g = _graded(spark, sf).select(F.col("set").alias("data_type"), "audience", "ok")
    types = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("data_type")).distinct()
    cells = types.select("data_type", F.explode(F.array(*[F.lit(x) for x in "FOPX"])).alias("audience"))
    return E.coverage_matrix(cells, g, types.where("data_type <> '5-LOW'"))


@query("routing_distribution", "Q26 Q25", """
WITH a AS (SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS level FROM events) SELECT level, count(*)::BIGINT AS n, (SELECT round(count(*) FILTER (level <= 2) / count(*)::DOUBLE, 4) FROM a) AS lower_two_share FROM a GROUP BY level
""")
def routing_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lv = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    return E.routing_distribution(table(spark, sf, "events").select(lv.alias("level")))


@query("golden_rollup", "Q25", """
SELECT event_type AS dimension, (count(*) FILTER (value < 100))::BIGINT AS passed, count(*)::BIGINT AS total FROM events GROUP BY 1
""")
def golden_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.dimension_rollup(table(spark, sf, "events").select(F.col("event_type").alias("dimension"), (F.col("value") < 100).alias("ok")))


@query("template_questions", "Q27 S25", """
WITH d AS (SELECT url, arg_min(page_id, page_id) AS document_id, trim(regexp_replace(regexp_extract(arg_min(html, page_id), '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS t0 FROM pages GROUP BY url),
t AS (SELECT document_id, coalesce(nullif(trim(regexp_replace(t0, '^\\s*(?:\\d+[\\s._-]*)+', '')), ''), t0) AS t FROM d WHERE t0 <> ''),
q AS (SELECT document_id, unnest([0, 1, 2]) AS pos, unnest(['what is ' || t, 'what does ' || t || ' cover', 'when was ' || t || ' updated']) AS question FROM t),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM q)
SELECT document_id, pos::INTEGER AS pos, question, substr(sha256(k), 1, 16) AS answer_key FROM k
""")
def template_questions(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import collapse

    p = wide_table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("document_id"), F.min_by("html", "page_id").alias("html"))
    d = p.select("document_id", F.lit("text/html").alias("mime"), F.lit("").alias("uri"), collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    q = E.template_questions(d)
    return q.select("document_id", "pos", "question", E.answer_key(F.col("question")).alias("answer_key"))


@query("bake_recommendations", "Q28", """
WITH f AS (SELECT json_extract_string(props, '$.k')::BIGINT AS document_id, event_id AS seq, 'q' || event_id AS question, CASE WHEN value > 50 THEN 'gap' WHEN value > 10 THEN 'uncited' ELSE 'failed' END AS code FROM events WHERE event_type = 'error'),
r AS (SELECT document_id, code, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT document_id, sum(n)::BIGINT AS failed, string_agg(code || '=' || n, ',' ORDER BY code) AS reasons FROM r GROUP BY 1),
s AS (SELECT document_id, array_to_string(list(question ORDER BY seq)[1:6], ',') AS questions FROM f GROUP BY 1)
SELECT * FROM t JOIN s USING (document_id) ORDER BY failed DESC, document_id LIMIT 50
""")
def bake_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'")
    f = e.select(F.get_json_object("props", "$.k").cast("long").alias("document_id"), F.col("event_id").alias("seq"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"), F.when(F.col("value") > 50, "gap: low").when(F.col("value") > 10, "uncited").otherwise("").alias("reason"))
    r = E.bake_recommendations(f)
    return r.withColumn("questions", F.array_join("questions", ","))


def registry_table(spark: SparkSession, sf: str) -> DataFrame:
    """Known questions: part types and brands as patterns with a slot."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"), F.min("p_type").alias("t"))
    return p.select(F.col("seq").alias("entry_id"), "seq", F.concat(F.lit("how many <kind> "), "p_name").alias("pattern"), F.array(F.concat(F.lit("How many "), "p_name", F.lit(" are there?"))).alias("examples"), F.lit(True).alias("enabled"),
                    F.when(F.col("t").isin("SMALL", "LARGE"), F.array(F.lit("business"))).otherwise(F.array(F.lit("developer"), F.lit("tester"))).alias("persona"))


@query("known_questions", "J18", """
WITH r AS (SELECT p_name, min(p_partkey) AS seq, list_distinct(list_concat(['many'], regexp_extract_all(lower(p_name), '[a-z0-9]+'))) AS fixed, 'how many ' || lower(p_name) || ' are there' AS ex FROM part GROUP BY 1),
q AS (SELECT p_partkey AS query_id, 'how many ' || p_name || CASE WHEN p_size > 25 THEN ' are there' ELSE ' of ' || p_brand END AS t FROM part),
q2 AS (SELECT query_id, lower(t) AS qn, regexp_extract_all(lower(t), '[a-z0-9]+') AS qt FROM (SELECT query_id, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM q)),
m AS (SELECT query_id, seq, CASE WHEN qn = ex THEN 2 ELSE 1 END AS tier, len(fixed) AS nf FROM q2 JOIN r ON qn = ex OR list_has_all(qt, fixed))
SELECT query_id, seq AS entry_id, tier::INTEGER AS tier, nf::INTEGER AS nf FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, nf DESC, seq) = 1
""")
def known_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("how many "), "p_name", F.when(F.col("p_size") > 25, " are there").otherwise(F.concat(F.lit(" of "), "p_brand"))).alias("text"))
    return E.known_question_match(q, registry_table(spark, sf))


@query("audience_suggestions", "Q29 P7", """
WITH r AS (SELECT p_name, min(p_partkey) AS seq, min(p_type) AS t FROM part GROUP BY 1) SELECT seq, seq AS entry_id, 'How many ' || p_name || ' are there?' AS question FROM r WHERE t IN ('SMALL', 'LARGE') ORDER BY seq LIMIT 6
""")
def audience_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return E.audience_suggestions(registry_table(spark, sf), F.array(F.lit("business"), F.lit("hr")))


@query("bank_gate", "P7 P2", """
WITH e AS (SELECT o_custkey AS question_id, o_orderpriority FROM orders) SELECT question_id FROM e GROUP BY 1 HAVING bool_and(o_orderpriority <> '1-URGENT')
""")
def bank_gate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.guards import bank_gate as gate

    o = table(spark, sf, "orders")
    bank = o.groupBy(F.col("o_custkey").alias("question_id")).agg(F.collect_set("o_orderpriority").alias("expected"))
    acl = o.select(F.col("o_orderpriority").alias("document_id")).distinct().withColumn("acl", F.when(F.col("document_id") == "1-URGENT", F.array(F.lit("restricted"))).otherwise(F.array(F.lit("public"))))
    return gate(bank, acl, ["public"])


@query("volume_expectations", "Q32", """
WITH c AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY 1), e AS (SELECT DISTINCT source, source <> 'src7' AS ok FROM documents), j AS (SELECT e.source, coalesce(n, 0) AS n, ok FROM e LEFT JOIN c USING (source) WHERE coalesce(n, 0) < 6)
SELECT source, n::BIGINT AS n, 6::INTEGER AS need, CASE WHEN n = 0 AND ok THEN source || ': preflight OK but 0 documents' ELSE source || ': only ' || n || ' documents (need 6)' END AS message FROM j
""")
def volume_expectations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    e = d.select("source").distinct().select("source", F.lit("documents").alias("unit"), F.lit(6).alias("need"), (F.col("source") != "src7").alias("preflight_ok"))
    return E.volume_expectations(e, d.where("lang = 'es'").groupBy("source").agg(F.count(F.lit(1)).alias("n")))


@query("policy_check", "P6", """
WITH r AS (SELECT c_custkey AS request_id, c_mktsegment AS seg, c_acctbal FROM customer)
SELECT request_id, (seg <> 'FURNITURE') AND NOT (seg = 'BUILDING' AND c_acctbal <= 0) AND seg <> 'HOUSEHOLD' AS allowed,
 CASE WHEN seg IN ('FURNITURE', 'HOUSEHOLD') THEN 'role' WHEN seg = 'BUILDING' AND c_acctbal <= 0 THEN 'budget' ELSE 'ok' END AS reason FROM r
""")
def policy_check(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.guards import ROLE_ACTIONS, policy_check as check

    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    r = c.select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").cast("string").alias("tenant"),
        F.when(seg == "FURNITURE", F.array(F.lit("asker"), F.lit("agent"))).when(seg == "HOUSEHOLD", F.array(F.lit("guest"))).when(seg == "BUILDING", F.array(F.lit("asker"))).otherwise(F.array(F.lit("curator"), F.lit("asker"))).alias("roles"),
        F.when(seg == "FURNITURE", "curate").when(seg == "BUILDING", "ask").when(seg == "HOUSEHOLD", "ask").otherwise("promote").alias("action"),
    )
    acts = spark.createDataFrame([(k, a) for k, v in ROLE_ACTIONS.items() for a in v], "role string, action string")
    return check(r, acts, c.select(F.col("c_custkey").cast("string").alias("tenant"), F.col("c_acctbal").alias("remaining")))
