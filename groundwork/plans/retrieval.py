"""Lexical and vector retrieval, fusion and boosts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import abstract, overview, paragraphs, tokens, content_tokens
from ..functions.udfs import hash_embed
from ..operators import fusion, retrieval, search, vectors
from ..operators.skew import top_k
from ..registry import query
from ..session import cut_lineage, shared_folder, table
from .common import SQL_RESTRICTED, documents, embeddings, questions

_BM25 = f"""
q AS (SELECT item_id AS query_id, text, length(text) > 200 AS wide FROM benchmark),
cls AS (SELECT * FROM (VALUES (TRUE), (FALSE)) t(wide)),
vis AS (SELECT c.wide, d.doc_id, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS toks
        FROM documents d JOIN cls c ON c.wide OR NOT ({SQL_RESTRICTED})),
st AS (SELECT wide, count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM vis GROUP BY wide),
qt AS (SELECT query_id, wide, term, count(*) AS qtf FROM
       (SELECT query_id, wide, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q) GROUP BY ALL),
po AS (SELECT wide, doc_id, dl, term, count(*) AS tf FROM
       (SELECT wide, doc_id, len(toks) AS dl, unnest(toks) AS term FROM vis)
       WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT wide, term, count(*) AS df FROM po GROUP BY ALL),
sc AS (SELECT qt.query_id, po.doc_id,
         round(sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1
           / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS score
       FROM po JOIN qt ON po.term = qt.term AND po.wide = qt.wide
       JOIN dfs ON dfs.term = po.term AND dfs.wide = po.wide JOIN st ON st.wide = po.wide
       GROUP BY ALL)
"""


def stored_index(spark: SparkSession, sf: str) -> str:
    """Folder of the lexical index over ``documents``, written by the first query of the session that needs it."""
    sc = spark.sparkContext
    known = sc.__dict__.setdefault("_groundwork_indexes", {})
    if sf not in known:
        path = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
        search.add_segment(documents(spark, sf).withColumn("tenant", F.lit("t1")), path)
        known[sf] = path
    return known[sf]


def bm25(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return search.search(spark, stored_index(spark, sf), questions(spark, sf).withColumn("tenant", F.lit("t1")), k)


@query("passages_paragraphs", "C3 C13 S18", """
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda x: trim(x, e' \\t\\n\\r')), lambda x: x <> '') AS ps FROM documents),
e AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS i FROM p)
SELECT doc_id, i::BIGINT AS pos, (i // 4 + 1)::BIGINT AS page, (i % 4 + 1)::BIGINT AS paragraph, length(text)::BIGINT AS n_chars,
  md5(text) AS text_md5 FROM e
""")
def passages_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.convert import paragraph_passages

    p = paragraph_passages(table(spark, sf, "documents"), "text", r"\n")
    return p.select("doc_id", "pos", "page", "paragraph", F.length("passage").cast("long").alias("n_chars"), F.md5("passage").alias("text_md5"))


@query("passage_abstracts", "C13", r"""
WITH s AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
x AS (SELECT doc_id, text, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM s)
SELECT doc_id, md5(p[1]) AS abstract_md5, md5(array_to_string(p[1:2], ' ')) AS overview_md5 FROM x
""")
def passage_abstracts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(abstract("text")).alias("abstract_md5"), F.md5(overview("text")).alias("overview_md5"))


@query("token_stats", "R1 C26", r"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct,
  greatest(1, round_even(len(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '')) * 13e-1, 0))::BIGINT AS n_model_tokens
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)
""")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import token_count

    d = documents(spark, sf).select("doc_id", "text", tokens("text").alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        token_count("text").alias("n_model_tokens"),
    )


@query("lexical_index", "R44 R1", f"""
WITH t AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE NOT ({SQL_RESTRICTED})),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, max(tf)::BIGINT AS max_tf FROM p GROUP BY term
""")
def lexical_index(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_counts(spark, stored_index(spark, sf), "t1", ["public"])


@query("bm25_topk", "R4 P2", f"""
WITH {_BM25}
SELECT query_id, doc_id AS passage_id, score, rn::BIGINT AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 20
""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25(spark, sf).select("query_id", "passage_id", "score", F.col("rank").cast("long").alias("rank"))


_COS = """
v AS (SELECT vec_id AS id, vec_id // 4 AS document_id, label, embedding::DOUBLE[] AS vec FROM embeddings)
"""


@query("cosine_topk", "R3 J1 P2", f"""
WITH {_COS}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.vec, b.vec), 6) + 0e0 AS score
  FROM v a JOIN v b ON a.document_id <> b.document_id)
SELECT query_id, id, score, rn::BIGINT AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 10
""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = embeddings(spark, sf)
    out = vectors.cosine_topk(v, v, 10, different="document_id")
    return out.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("rrf_fusion", "R5", f"""
WITH {_COS}, s AS (SELECT a.id AS query_id, b.id, a.label = b.label AS same, round(list_dot_product(a.vec, b.vec), 6) + 0e0 AS score
  FROM v a JOIN v b ON a.document_id <> b.document_id),
l1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s),
l2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s WHERE same),
u AS (SELECT * FROM l1 WHERE rn <= 20 UNION ALL SELECT * FROM l2 WHERE rn <= 20)
SELECT query_id, id AS passage_id, round(sum(1e0 / (60 + rn)), 12) AS fused FROM u GROUP BY ALL
""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    v = embeddings(spark, sf)
    a = vectors.cosine_topk(v, v, 20, different="document_id")
    b = vectors.cosine_topk(v, v, 20, different="document_id", same="label")  # a second list under another filter
    return fusion.rrf(*[x.withColumnRenamed("id", "passage_id") for x in (a, b)])


@query("near_duplicates", "J10 Q6", """
WITH v AS (SELECT vec_id AS id, vec_id // 4 AS document_id, embedding::DOUBLE[] AS vec FROM embeddings),
p AS (SELECT a.id, b.id AS other, a.document_id AS da, b.document_id AS db, list_dot_product(a.vec, b.vec) AS c FROM v a JOIN v b ON a.document_id <> b.document_id
      WHERE list_dot_product(a.vec, b.vec) >= 45e-2)
SELECT id, CASE WHEN count(*) FILTER (db < da) > 0 THEN arg_min(other, db * 1000000000 + other) END AS dup_of,
  CASE WHEN count(*) FILTER (db < da) > 0 THEN round(least(1e0, arg_min(c, db * 1000000000 + other)), 6) END AS cosine,
  (count(*) FILTER (db < da))::BIGINT AS originals, (count(*) FILTER (db > da))::BIGINT AS copies
FROM p GROUP BY id
""")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    # the stored vectors hold no pair at the duplicate threshold of 0.92; 0.45 gives twins to find
    return vectors.near_duplicates(embeddings(spark, sf), 0.45)


@query("document_near_duplicates", "J10 R2")
def document_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    v = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("seq"), hash_embed("text").alias("vec"))
    v = cut_lineage(v)  # the stored vectors: embedded once, read several times
    return vectors.near_duplicates(v.where(F.exists("vec", lambda x: x != 0)))


@query("hash_embed", "R2")
def hash_embed_query(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", hash_embed("text").alias("vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return d.select("doc_id", F.round(norm, 6).alias("norm"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("source_ranks", "R6 R8 J19", """
WITH dflt(source, rank) AS (VALUES ('files',1),('confluence',2),('sharepoint',2),('github',3),('jira',4),('drive',3),('upload',2),('cli',2)),
ov AS (SELECT DISTINCT source, (CAST(substr(source, 4) AS INTEGER) % 5 + 1) AS rank FROM documents WHERE lang = 'de'),
n AS (SELECT source FROM dflt UNION SELECT source FROM ov UNION SELECT source FROM documents)
SELECT n.source, coalesce(ov.rank, dflt.rank, 5)::INTEGER AS rank,
  round(1e0 / (1e0 + 25e-2 * (coalesce(ov.rank, dflt.rank, 5) - 1)), 6) AS weight, ov.rank IS NOT NULL AS overridden
FROM n LEFT JOIN ov USING (source) LEFT JOIN dflt USING (source)
""")
def source_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf)


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    ov = d.where("lang = 'de'").select("source").distinct().withColumn("rank", F.expr("cast(substr(source, 4) as int) % 5 + 1"))
    dflt = spark.createDataFrame(list(fusion.DEFAULT_RANKS.items()), "source string, rank int")
    return fusion.source_ranks(dflt, ov, d)


@query("authority_boost", "R7 R6 Q30", f"""
WITH {_BM25},
f AS (SELECT query_id, doc_id, round(1e0 / (60 + rn), 12) AS fused, rn FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 20),
ov AS (SELECT DISTINCT source, (CAST(substr(source, 4) AS INTEGER) % 5 + 1) AS rank FROM documents WHERE lang = 'de'),
b AS (SELECT query_id, f.doc_id, rn, round(fused * (round(1e0 / (1e0 + 25e-2 * (coalesce(ov.rank, 5) - 1)), 6) *
   CASE WHEN coalesce(l.quality = 1 AND l.toxic = 0, FALSE) THEN 15e-1 ELSE 1e0 END), 8) AS boosted
 FROM f JOIN documents d USING (doc_id) LEFT JOIN ov USING (source) LEFT JOIN labels l USING (doc_id))
SELECT query_id, doc_id AS passage_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rn)::BIGINT AS rank FROM b
""")
def authority_boost(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25(spark, sf)
    fused = fusion.rrf(hits).join(hits.select("query_id", "passage_id", F.col("rank").alias("idx")), ["query_id", "passage_id"])
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("authoritative"))
    out = fusion.authority_boost(fused, documents(spark, sf), _ranks(spark, sf), marks)
    return out.select("query_id", "passage_id", "boosted", F.col("rank").cast("long").alias("rank"))


@query("distinctive_titles", "R10", r"""
WITH t AS (SELECT DISTINCT c_custkey AS document_id, unnest(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[a-z0-9]+')) AS token FROM customer
  UNION SELECT DISTINCT 1000000000 + p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+')) FROM part)
SELECT token, min(document_id)::BIGINT AS document_id FROM t GROUP BY token HAVING count(*) = 1
""")
def distinctive_titles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("title"))
    p = table(spark, sf, "part").select((F.col("p_partkey") + 1000000000).alias("document_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return fusion.distinctive_titles(c.unionByName(p))


# Titles of the document table: the first six words of the text.
_TITLES = r"titles AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+')[1:6], ' ') AS title FROM documents)"
_SUBJ = rf"""{_TITLES},
tt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS token FROM titles),
dist AS (SELECT token, min(doc_id) AS doc_id FROM tt GROUP BY token HAVING count(*) = 1),
qtk AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
stopw AS (SELECT unnest(string_split('the a an of to in on for and or is are what which how who when where does do did was were be with that this it as by at from our we you i can will should must may', ' ')) AS token),
subj AS (SELECT DISTINCT query_id, doc_id FROM qtk JOIN dist USING (token) WHERE token NOT IN (SELECT token FROM stopw))"""


def titled(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return d.withColumn("title", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 6), " "))


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.question_subjects(questions(spark, sf), fusion.distinctive_titles(titled(spark, sf)))


@query("question_subjects", "R10 R11", f"WITH {_SUBJ} SELECT query_id, doc_id AS document_id FROM subj")
def question_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects(spark, sf)


@query("subject_boost", "R11", f"""
WITH {_BM25}, {_SUBJ},
f AS (SELECT query_id, doc_id, round(1e0 / (60 + rn), 12) AS fused FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 20),
mx AS (SELECT query_id, max(fused) AS mx FROM f GROUP BY query_id),
up AS (SELECT f.query_id, f.doc_id, fused + CASE WHEN s.doc_id IS NOT NULL THEN mx ELSE 0e0 END AS fused, FALSE AS injected
  FROM f JOIN mx USING (query_id) LEFT JOIN subj s ON s.query_id = f.query_id AND s.doc_id = f.doc_id),
ad AS (SELECT s.query_id, s.doc_id, mx, TRUE FROM subj s JOIN mx USING (query_id)
  JOIN documents d ON d.doc_id = s.doc_id JOIN q ON q.query_id = s.query_id
  WHERE NOT ({SQL_RESTRICTED}) AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = s.query_id AND f.doc_id = s.doc_id))
SELECT query_id, doc_id AS passage_id, round(fused, 9) AS fused, injected FROM (SELECT * FROM up UNION ALL SELECT * FROM ad)
""")
def subject_boost(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25(spark, sf)
    fused = fusion.rrf(hits).withColumn("document_id", F.col("passage_id"))
    seen = documents(spark, sf).where(~F.array_contains("acl", "restricted")).withColumn("pos", F.lit(0))
    out = fusion.subject_boost(fused, subjects(spark, sf), seen.select("passage_id", "document_id", "pos"))
    return out.select("query_id", "passage_id", F.round("fused", 9).alias("fused"), "injected")


@query("mmr_select", "R15")
def mmr_select(spark: SparkSession, sf: str) -> DataFrame:
    v = embeddings(spark, sf)
    hits = vectors.cosine_topk(v, v, 15, different="document_id")
    c = fusion.rrf(hits.withColumnRenamed("id", "passage_id")).withColumnRenamed("passage_id", "id")
    c = c.join(hits, ["query_id", "id"]).join(v.select("id", "vec"), "id")
    c = c.select("query_id", "id", F.col("rank").alias("pos"), "fused", F.col("score").alias("vscore"), "vec")
    return vectors.mmr(c, 5).withColumn("mmr", F.round("mmr", 6))


@query("review_holdout", "P5", """
SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1
""")
def review_holdout(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.guards import hold_out_review

    state = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "review").otherwise("live").alias("state"))
    return hold_out_review(documents(spark, sf), state).select("doc_id", "source")


def hybrid(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Hybrid search with citations: BM25 and vector lists over visible passages, fused and boosted."""
    q, d = questions(spark, sf), documents(spark, sf)
    lex = bm25(spark, sf)
    qv = q.select(F.col("query_id").alias("id"), hash_embed("text").alias("vec"), retrieval.access_key(F.col("accessible")).alias("access"))
    dv = cut_lineage(d.select(F.col("passage_id").alias("id"), hash_embed("text").alias("vec"), "acl"))
    classes = q.select(retrieval.access_key(F.col("accessible")).alias("access"), "accessible").dropDuplicates(["access"])
    seen = retrieval.visible_passages(dv.withColumnRenamed("id", "passage_id"), classes).withColumnRenamed("passage_id", "id")
    sem = vectors.cosine_topk(qv, seen, 20, same="access")
    sem = sem.withColumnRenamed("id", "passage_id")
    fused = fusion.rrf(lex, sem)
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.col("passage_id"))
    fused = fused.withColumn("idx", F.row_number().over(w))
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("authoritative"))
    ranked = fusion.authority_boost(fused, d, _ranks(spark, sf), marks)
    top = top_k(ranked.drop("rank"), ["query_id"], [F.desc("boosted"), F.col("passage_id")], k)
    cite = d.select("passage_id", "source", F.substring(abstract("text"), 1, 200).alias("snippet"))
    return top.join(cite, "passage_id").select(
        "query_id", F.col("rank").cast("long").alias("citation"), "passage_id", "document_id", "source", "boosted", "snippet"
    )


@query("hybrid_search", "R4 R3 R5 R7 R35 P2")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid(spark, sf)
