"""Selection, grounding, composition, plans and follow-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import persona as P
from ..functions.text import content_tokens, sentences, tokens
from ..operators import answers as A
from ..operators import execution, fusion, names, search
from ..operators.retrieval import citation_context as context
from ..operators.retrieval import merge_hits, page_read
from ..registry import query
from ..session import cut_lineage, shared_folder, table, wide_table
from .common import documents, questions
from .conversion import _QSQL, _SENT, question_log
from .retrieval import _BM25, _SUBJ, bm25, subjects

_STOPS = "('the','a','an','of','to','in','on','for','and','or','is','are','what','which','how','who','when','where','does','do','did','was','were','be','with','that','this','it','as','by','at','from','our','we','you','i','can','will','should','must','may')"
_CT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: t NOT IN " + _STOPS + ")"
_SEL = f"""{_BM25},
sel AS (SELECT s.query_id, s.doc_id, s.rn AS pick, s.score, round(1e0 / (60 + s.rn), 12) AS fused, round(least(1e0, s.score / 5e1), 6) AS vscore, d.text, d.source FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0) s JOIN documents d USING (doc_id) WHERE rn <= 5)"""


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """First five lexical hits per question with their text."""
    hits = cut_lineage(bm25(spark, sf, 5))
    d = documents(spark, sf).select("passage_id", "document_id", "text", "source")
    return hits.join(d, "passage_id").select(
        "query_id", "passage_id", "document_id", F.col("rank").alias("pick"), F.round(1.0 / (60 + F.col("rank")), 12).alias("fused"), F.round(F.least(F.lit(1.0), F.col("score") / 50.0), 6).alias("vscore"), "text", "source",
    )


@query("grounding_decision", "R17 R18 R19 R20 R21", f"""
WITH {_SEL}, qk AS (SELECT item_id AS query_id, {_CT.format('text')} AS qt FROM benchmark),
x AS (SELECT s.*, qt, list_intersect(qt, regexp_extract_all(lower(s.text), '[a-z0-9]+')) AS sh FROM sel s JOIN qk USING (query_id)),
b AS (SELECT query_id, least(1e0, max(fused) / (2e0 / 61)) AS s1, greatest(0e0, least(1e0, max(vscore))) AS s2, max(len(qt)) AS nq, count(*) AS n, count(*) FILTER (len(sh) > 0) AS cor, count(*) FILTER (source <> 'src2') AS loc FROM x GROUP BY 1),
c AS (SELECT query_id, count(DISTINCT t) AS cov FROM (SELECT query_id, unnest(sh) AS t FROM x) GROUP BY 1),
g AS (SELECT *, CASE WHEN nq > 0 THEN coalesce(cov, 0) / nq ELSE 5e-1 END AS s3, CASE WHEN nq > 0 THEN least(1e0, cor / least(3, n)) ELSE s2 END AS s4, loc / n::DOUBLE AS s5 FROM b LEFT JOIN c USING (query_id)),
h AS (SELECT *, round(exp((ln(greatest(s1, 1e-6)) + 12e-1 * ln(greatest(s2, 1e-6)) + 12e-1 * ln(greatest(s3, 1e-6)) + 8e-1 * ln(greatest(s4, 1e-6)) + ln(greatest(s5, 1e-6))) / 52e-1), 4) AS g FROM g),
top AS (SELECT query_id, list(fused ORDER BY fused DESC)[1:2] AS t FROM sel WHERE pick <= 4 GROUP BY 1)
SELECT query_id, round(s1, 4) AS retrieval, round(s2, 4) AS semantic, round(s3, 4) AS coverage, round(s4, 4) AS agreement, round(s5, 4) AS resolvable, g AS grounding,
 CASE WHEN g >= 6e-1 THEN 'answer' WHEN g >= 3e-1 THEN 'clarify' ELSE 'gap' END AS decision, round(least(99e-2, g * 9e-1 + 5e-2 * 2 / n), 3) AS confidence, coalesce(t[2] > 0 AND (t[1] - t[2]) / (t[1] + 1e-6) < 15e-2, FALSE) AS ambiguous FROM h JOIN top USING (query_id)
""")
def grounding_decision(spark: SparkSession, sf: str) -> DataFrame:
    s = selected(spark, sf).withColumn("located", F.col("source") != "src2")
    q = questions(spark, sf).select("query_id", content_tokens("text").alias("qtok"))
    s = cut_lineage(s.join(q, "query_id").withColumn("ptok", tokens("text")).drop("text"))
    g = fusion.grounding(s).join(fusion.ambiguous(s), "query_id")
    n = s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.join(n, "query_id")
    final = fusion.exact_signal_floor(F.col("grounding"), F.lit(False), 0.6)
    return g.select("query_id", *fusion.GROUNDING, "grounding", fusion.decision(final, 0.6).alias("decision"), fusion.confidence(F.col("grounding"), F.lit(2), F.col("n")).alias("confidence"), "ambiguous")


_POOL = rf"""{_SEL}, {_SUBJ}, qk AS (SELECT item_id AS query_id, {_CT.format('text')} AS qt FROM benchmark),
ps AS (SELECT s.query_id, s.doc_id, s.vscore, qt, sj.doc_id IS NOT NULL AS is_subject, {_SENT.format('s.text')} AS ss FROM sel s JOIN qk USING (query_id) LEFT JOIN subj sj ON sj.query_id = s.query_id AND sj.doc_id = s.doc_id),
pu AS (SELECT query_id, doc_id, vscore, qt, is_subject, unnest(ss) AS raw, generate_subscripts(ss, 1) - 1 AS pos FROM ps),
pc AS (SELECT *, regexp_replace(trim(regexp_replace(trim(regexp_replace(raw, 'https?://\S+', '', 'g')), '^[A-Z][A-Za-z0-9 .&/''’-]{{0,40}}:\s+', '')), '\s{{2,}}', ' ', 'g') AS sentence FROM pu),
pf AS (SELECT * FROM pc WHERE sentence <> '' AND NOT (length(sentence) < 25 OR contains(lower(sentence), 'http') OR contains(sentence, '://') OR sentence LIKE '%:' OR (right(sentence, 1) NOT IN ('.', '!', '?') AND len(regexp_split_to_array(sentence, '\s+')) <= 6))),
pb AS (SELECT *, len(list_intersect(qt, {_CT.format('sentence')})) * CASE WHEN right(sentence, 1) IN ('.', '!', '?') AND len(regexp_split_to_array(sentence, '\s+')) >= 6 THEN 1e0 ELSE 35e-2 END AS base FROM pf),
pool AS (SELECT query_id, doc_id, pos, sentence, is_subject, round(base + CASE WHEN is_subject THEN 15e-1 ELSE 0e0 END + 1e-4 * vscore, 8) AS score FROM pb WHERE base > 0 OR is_subject)"""


def pool(spark: SparkSession, sf: str) -> DataFrame:
    sub = subjects(spark, sf).withColumn("_s", F.lit(True))
    s = selected(spark, sf).join(sub, ["query_id", "document_id"], "left").withColumn("is_subject", F.coalesce("_s", F.lit(False)))
    return A.sentence_pool(s, questions(spark, sf))


@query("extractive_sentences", "R27", f"WITH {_POOL} SELECT query_id, doc_id AS document_id, pos::INTEGER AS pos, score, is_subject, md5(sentence) AS sentence_md5 FROM pool")
def extractive_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).select("query_id", "document_id", "pos", "score", "is_subject", F.md5("sentence").alias("sentence_md5"))


@query("composed_answers", "R28", f"""
WITH {_POOL}, d1 AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, sentence ORDER BY score DESC, doc_id, pos) = 1),
d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, pos) <= CASE WHEN is_subject THEN 2 ELSE 1 END),
d3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS r FROM d2 QUALIFY r <= 3),
nn AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS n FROM d3 GROUP BY query_id, doc_id)
SELECT query_id, md5(string_agg(sentence || ' [' || n || ']', ' ' ORDER BY r)) AS answer_md5, count(DISTINCT doc_id)::INTEGER AS citations FROM d3 JOIN nn USING (query_id, doc_id) GROUP BY query_id
""")
def composed_answers(spark: SparkSession, sf: str) -> DataFrame:
    a = A.compose(cut_lineage(pool(spark, sf)))
    return a.select("query_id", F.md5("answer").alias("answer_md5"), F.size("citations").alias("citations"))


@query("document_lead", "R28")
def document_lead(spark: SparkSession, sf: str) -> DataFrame:
    p = documents(spark, sf).select("document_id", "passage_id", F.lit(0).alias("pos"), "text")
    return A.document_lead(subjects(spark, sf), p, questions(spark, sf))


@query("postcheck", "R29", rf"""
WITH {_SEL}, an AS (SELECT item_id AS query_id, {_SENT.format('text')} AS ss FROM benchmark), u AS (SELECT query_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS pos FROM an),
t AS (SELECT *, {_CT.format('s')} AS st FROM u), k AS (SELECT t.query_id, t.pos, max(len(list_intersect(st, regexp_extract_all(lower(sel.text), '[a-z0-9]+'))) / len(st)) AS sup FROM t JOIN sel USING (query_id) WHERE len(st) > 0 GROUP BY ALL)
SELECT t.query_id, t.pos::INTEGER AS pos, round(coalesce(sup, 0e0), 6) AS support, coalesce(sup, 0e0) >= 5e-1 OR regexp_matches(s, '\[\d+\]') AS kept FROM t LEFT JOIN k ON k.query_id = t.query_id AND k.pos = t.pos WHERE len(st) > 0
""")
def postcheck(spark: SparkSession, sf: str) -> DataFrame:
    return A.postcheck(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), selected(spark, sf)).drop("sentence")


@query("ensure_subject", "R16", f"""
WITH {_BM25}, {_SUBJ}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0), se AS (SELECT * FROM r WHERE rn <= 3), ca AS (SELECT * FROM r WHERE rn <= 20),
has AS (SELECT query_id, bool_or(s.doc_id IS NOT NULL) AS has, count(*) AS n FROM se LEFT JOIN subj s USING (query_id, doc_id) GROUP BY 1), sw AS (SELECT query_id, arg_min(doc_id, rn) AS doc_id FROM ca JOIN subj USING (query_id, doc_id) GROUP BY 1)
SELECT se.query_id, se.doc_id AS passage_id, (rn + CASE WHEN NOT has AND sw.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS pick FROM se JOIN has USING (query_id) LEFT JOIN sw ON sw.query_id = se.query_id WHERE has OR sw.doc_id IS NULL OR rn < n
UNION ALL SELECT query_id, sw.doc_id, 1 FROM sw JOIN has USING (query_id) WHERE NOT has
""")
def ensure_subject(spark: SparkSession, sf: str) -> DataFrame:
    c = cut_lineage(bm25(spark, sf)).select("query_id", "passage_id", F.col("passage_id").alias("document_id"), F.col("rank").alias("pos"))
    sel = c.where("pos <= 3").withColumnRenamed("pos", "pick")
    return fusion.ensure_subject(sel, c, subjects(spark, sf)).select("query_id", "passage_id", F.col("pick").cast("long").alias("pick"))


@query("persona_boost", "R13", f"""
WITH {_SEL}, m AS (SELECT query_id, max(fused) AS mx FROM sel GROUP BY 1) SELECT query_id, doc_id AS passage_id, round(fused + CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 5e-1 * mx ELSE 0e0 END, 9) AS fused FROM sel JOIN m USING (query_id) LEFT JOIN labels l USING (doc_id)
""")
def persona_boost(spark: SparkSession, sf: str) -> DataFrame:
    s = selected(spark, sf).select("query_id", "passage_id", "document_id", "fused")
    auth = table(spark, sf, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("document_id"))
    out = fusion.persona_boost(s, s.join(auth, "document_id"))
    return out.select("query_id", "passage_id", F.round("fused", 9).alias("fused"))


_DESIG = ["CTO", "VP Sales", "Scrum lead", "QA lead", "Senior developer", "Curator", "Admin", "Team Lead", "Painter", "", "Test engineer", "Head of data", "Product owner"]


@query("persona_map", "R12", f"""
WITH d AS (SELECT c_custkey, ({'[' + ','.join(f"'{x}'" for x in _DESIG) + ']'})[c_nationkey % {len(_DESIG)} + 1] AS g FROM customer),
p AS (SELECT c_custkey, CASE g WHEN 'CTO' THEN 'executive' WHEN 'VP Sales' THEN 'executive' WHEN 'Scrum lead' THEN 'delivery' WHEN 'QA lead' THEN 'quality' WHEN 'Senior developer' THEN 'developer' WHEN 'Curator' THEN 'curation' WHEN 'Admin' THEN 'operations' WHEN 'Team Lead' THEN 'delivery'
  WHEN 'Test engineer' THEN 'quality' WHEN 'Head of data' THEN 'executive' WHEN 'Product owner' THEN 'delivery' ELSE 'general' END AS persona FROM d)
SELECT c_custkey, persona, (CASE persona WHEN 'executive' THEN 1 WHEN 'delivery' THEN 2 ELSE 3 END)::INTEGER AS depth, CASE persona WHEN 'developer' THEN 'code' WHEN 'quality' THEN 'test' WHEN 'delivery' THEN 'authority' WHEN 'executive' THEN 'authority' ELSE 'none' END AS emphasis FROM p
""")
def persona_map(spark: SparkSession, sf: str) -> DataFrame:
    d = F.element_at(F.array(*[F.lit(x) for x in _DESIG]), (F.col("c_nationkey") % len(_DESIG) + 1).cast("int"))
    c = table(spark, sf, "customer").select("c_custkey", P.persona_for(d).alias("persona"))
    return c.select("c_custkey", "persona", P.depth_cap(F.col("persona")).alias("depth"), P.emphasis(F.col("persona")).alias("emphasis"))


_LSTOP = "('the','a','an','of','to','in','on','for','and','or','is','are','what','which','how','who','when','where','does','do','did','was')"


@query("level_select", "R22 R23 C29", rf"""
WITH {_QSQL}, b AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'What is ' || split_part(t, ' ', 1) || '?' WHEN conv_id % 4 = 1 THEN 'which ' || substr(t, 1, 30) ELSE t END AS q, (turn % 4 + 1) AS spread, round((conv_id % 10) / 1e1, 4) AS g, turn % 5 = 0 AS graph, CASE WHEN conv_id % 8 = 0 THEN split_part(t, ' ', 1) || ' guide' ELSE 'other' END AS title FROM q),
c AS (SELECT *, lower(q) AS l, len(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda t: t NOT IN {_LSTOP})) AS n FROM b),
d AS (SELECT *, regexp_matches(l, 'why|how|compare|difference|explain|analyse|analyze|evaluate|recommend|implication|trade-off|tradeoff|versus|vs') AS rs, coalesce(list_filter(regexp_split_to_array(l, '\s+'), lambda x: x <> '')[1], '') AS f FROM c),
e AS (SELECT *, CASE WHEN rs THEN 3 WHEN f IN ('what','which','who','when','where','list','define','status') AND n <= 8 THEN 1 ELSE 2 END AS base,
  NOT rs AND title <> '' AND len(list_filter(list_filter(regexp_extract_all(lower(regexp_extract(trim(q), '(?i)^\s*(?:what|who)\s+(?:is|are)\s+(.+?)\??$', 1)), '[a-z0-9]+'), lambda t: t NOT IN {_LSTOP}), lambda t: contains(lower(title), t))) > 0 AS lk FROM d),
l1 AS (SELECT *, CASE WHEN lk THEN 1 ELSE base END AS v1 FROM e), l2 AS (SELECT *, NOT lk AND spread >= 2 AND v1 < 2 AS up FROM l1), l3 AS (SELECT *, CASE WHEN up THEN 2 ELSE v1 END AS v2 FROM l2), l4 AS (SELECT *, CASE WHEN graph AND NOT lk AND v2 < 2 THEN 2 ELSE v2 END AS v3 FROM l3),
l5 AS (SELECT *, n >= 12 AND v3 < 3 AND NOT lk AS lq FROM l4), l6 AS (SELECT *, CASE WHEN lq THEN 3 ELSE v3 END AS v4 FROM l5)
SELECT conv_id, turn, v4::INTEGER AS level, ((v4 + CASE WHEN g < 35e-2 THEN 1 ELSE 0 END))::INTEGER AS escalated, array_to_string(list_filter([CASE base WHEN 3 THEN 'reasoning_intent' WHEN 1 THEN 'factual_lookup' ELSE 'synthesis' END, CASE WHEN lk THEN 'definition' END, CASE WHEN up AND spread >= 3 THEN 'multi_document' WHEN up THEN 'two_document' END,
 CASE WHEN graph AND NOT lk THEN 'graph_multi_hop' END, CASE WHEN lq THEN 'long_query' END, CASE WHEN v4 = 1 AND g >= 7e-1 THEN 'high_grounding' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l6
""")
def level_select(spark: SparkSession, sf: str) -> DataFrame:
    q, c, t = F.col("question"), F.col("conv_id"), F.col("turn")
    first = F.element_at(F.split(q, " "), 1)
    d = question_log(spark, sf).select(
        "conv_id", "turn", F.when(c % 4 == 0, F.concat(F.lit("What is "), first, F.lit("?"))).when(c % 4 == 1, F.concat(F.lit("which "), F.substring(q, 1, 30))).otherwise(q).alias("question"), (t % 4 + 1).alias("doc_spread"),
        F.round((c % 10) / 10.0, 4).alias("grounding"), (t % 5 == 0).alias("graph_used"), F.when(c % 8 == 0, F.concat(first, F.lit(" guide"))).otherwise("other").alias("top_title"),
    )
    lv = fusion.select_level(d)
    up = fusion.escalate(lv.withColumn("confidence", F.col("grounding")))
    return lv.select("conv_id", "turn", "level", F.array_join("reasons", ",").alias("reasons")).join(up.select("conv_id", "turn", F.col("level").alias("escalated")), ["conv_id", "turn"])


@query("citation_context", "R37", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, e'\n')) AS text, generate_subscripts(string_split(text, e'\n'), 1) - 1 AS pos FROM documents), f AS (SELECT * FROM l WHERE trim(text) <> '')
SELECT doc_id AS document_id, doc_id * 100000 + pos AS passage_id, lag(doc_id * 100000 + pos) OVER w AS before, lead(doc_id * 100000 + pos) OVER w AS after FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
""")
def citation_context(spark: SparkSession, sf: str) -> DataFrame:
    c = context(line_passages(spark, sf), 1)
    return c.select("document_id", "passage_id", F.try_element_at("before", F.lit(1)).alias("before"), F.try_element_at("after", F.lit(1)).alias("after"))


def line_passages(spark: SparkSession, sf: str) -> DataFrame:
    p = documents(spark, sf).select("document_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where("trim(text) <> ''")
    return p.withColumn("passage_id", F.col("document_id") * 100000 + F.col("line")).withColumn("page", (F.floor(F.col("line") / 20) + 1).cast("int")).withColumn("paragraph", F.lit(1)).withColumn("start", F.lit(None).cast("int"))


@query("page_read", "R36", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, e'\n')) AS text, generate_subscripts(string_split(text, e'\n'), 1) - 1 AS pos FROM documents), f AS (SELECT *, (pos // 20 + 1)::INTEGER AS page FROM l WHERE trim(text) <> ''),
o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM f)
SELECT doc_id AS document_id, page, count(*)::BIGINT AS passages, md5(substr(string_agg(text, e'\n\n' ORDER BY pos), 1, 2000)) AS text_md5 FROM o WHERE off < 2000 GROUP BY ALL
""")
def page_read_query(spark: SparkSession, sf: str) -> DataFrame:
    p = page_read(line_passages(spark, sf), 2000)
    return p.select("document_id", "page", "passages", F.md5("text").alias("text_md5"))


@query("discover_merge", "R34 R35", f"""
WITH {_BM25}, b AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM sc WHERE score > 0) WHERE rn <= 20),
u AS (SELECT query_id, doc_id::VARCHAR AS k, score, 'lexical' AS searcher FROM b UNION ALL SELECT query_id, d.source, b.score * 2, 'source' FROM b JOIN documents d USING (doc_id)),
o AS (SELECT query_id, k AS hit_key, max(score) AS score FROM u GROUP BY ALL)
SELECT query_id, hit_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_key)::BIGINT AS rank FROM o QUALIFY rank <= 6
""")
def discover_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = cut_lineage(bm25(spark, sf))
    one = b.select("query_id", F.lit("").alias("url"), "passage_id", F.lit(None).cast("string").alias("path"), "score", F.lit("lexical").alias("searcher"))
    src = b.join(documents(spark, sf).select("passage_id", "source"), "passage_id").select("query_id", F.col("source").alias("url"), F.lit(None).cast("long").alias("passage_id"), F.lit(None).cast("string").alias("path"), (F.col("score") * 2).alias("score"), F.lit("source").alias("searcher"))
    return merge_hits(one.unionByName(src), 6).select("query_id", "hit_key", "score", F.col("rank").cast("long").alias("rank"))


# Follow-ups: subjects are tokens that one benchmark item alone uses.
_FPRE = ["what about ", "does it run ", "and ", "", "compare ", "the second one "]
_FOLLOW = f"""
sb AS (SELECT token AS key, upper(token) AS display FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY token HAVING count(*) = 1),
t AS (SELECT conv_id, turn, ({'[' + ','.join(f"'{x}'" for x in _FPRE) + ']'})[turn % {len(_FPRE)} + 1] || array_to_string(regexp_extract_all(text, '\\S+')[1:4], ' ') AS question FROM conversations),
k AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS key, generate_subscripts(regexp_extract_all(lower(question), '[a-z0-9]+'), 1) AS i FROM t),
ls AS (SELECT conv_id, turn, arg_max(key, i) AS subject, arg_max(display, i) AS display FROM k JOIN sb USING (key) GROUP BY ALL),
s AS (SELECT t.*, subject, display, lag(display, 1) OVER w AS p1, lag(display, 2) OVER w AS p2, lag(question, 1) OVER w AS pq, lag(subject, 1) OVER w AS pk FROM t LEFT JOIN ls USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("followup_subject", "R26", rf"""
WITH {_FOLLOW}, x AS (SELECT *, trim(question) AS q, coalesce(p1, p2) AS sticky, len(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: x NOT IN ('{"','".join(A.FOLLOW_STOP)}'))) AS content FROM s),
y AS (SELECT *, regexp_matches(q, '{A.PRONOUN.replace("'", "''")}') AS pron, NOT regexp_matches(q, '{A.HAS_VERB}') AND (regexp_matches(q, '{A.ELLIPSIS}') OR content <= 3) AS ell FROM x)
SELECT conv_id, turn, subject, CASE WHEN regexp_matches(q, '{A.CONTINUE}') AND subject IS NOT NULL AND pk IS NOT NULL AND pk <> subject THEN 'swap' WHEN subject IS NOT NULL THEN 'self' WHEN pron AND sticky IS NOT NULL THEN 'pronoun' WHEN ell AND sticky IS NOT NULL THEN 'ellipsis'
 WHEN ((pron OR ell) AND sticky IS NULL AND content < 2) OR (regexp_matches(q, '{A.NEEDS_TWO}') AND sticky IS NULL) THEN 'clarify' ELSE 'plain' END AS rule FROM y
""")
def followup_subject(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(tokens("text"))).alias("key"))
    sb = b.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("key", F.upper("key").alias("display"))
    pre = F.element_at(F.array(*[F.lit(x) for x in _FPRE]), (F.col("turn") % len(_FPRE) + 1).cast("int"))
    t = wide_table(spark, sf, "conversations").select("conv_id", "turn", F.concat(pre, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 4), " ")).alias("question"))
    return A.resolve_followups(t, sb).select("conv_id", "turn", "subject", "rule")


@query("compare_terms", "R42", f"""
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations), c AS (SELECT conv_id * 1000 + turn AS query_id, {_CT.format('text')} AS a, {_CT.format('nx')} AS b, text <> '' AND nx <> '' AS bth FROM p WHERE nx IS NOT NULL)
SELECT query_id, array_to_string(list_sort(list_intersect(a, b))[1:12], ',') AS shared, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))[1:12], ',') AS only_a, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x)))[1:12], ',') AS only_b, bth AS both_answered FROM c
""")
def compare_terms(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = wide_table(spark, sf, "conversations").withColumn("nx", F.lead("text").over(w)).where("nx is not null")
    c = A.compare_answers(p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer_a"), F.col("nx").alias("answer_b")))
    return c.select("query_id", *[F.array_join(x, ",").alias(x) for x in ("shared", "only_a", "only_b")], "both_answered")


@query("question_plan", "R24")
def question_plan(spark: SparkSession, sf: str) -> DataFrame:
    return A.plan_questions(plan_log(spark, sf))


def plan_log(spark: SparkSession, sf: str) -> DataFrame:
    """Turns phrased as conditionals, comparisons and chains of asks."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = wide_table(spark, sf, "conversations").withColumn("nx", F.coalesce(F.lead("text").over(w), F.lit("the rest"))).withColumn("h", F.array_join(F.slice(F.split("text", r"\s+"), 1, 4), " ")).withColumn("n", F.array_join(F.slice(F.split("nx", r"\s+"), 1, 4), " "))
    form = (F.col("conv_id") + F.col("turn")) % 4
    t = F.when(form == 0, F.concat(F.lit("If "), "h", F.lit(" then what is "), "n", F.lit(" otherwise explain the "), "h", F.lit("?"))).when(form == 1, F.concat(F.lit("Compare "), "h", F.lit(" with "), "n", F.lit("?"))).when(
        form == 2, F.concat(F.lit("What is "), "h", F.lit(" and how does "), "n", F.lit(" work; then list the "), "h")).otherwise(F.concat(F.lit("What is "), "h", F.lit("?")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), t.alias("text"))


# Turns as passages, and as conditions, denials and comparisons of their first sentences; a step is answered by the best sentence of its best passage.
_ASKED = rf"""st AS (SELECT conv_id * 1000 + turn AS pid, conv_id, turn, text, {_SENT.format('text')} AS ss FROM conversations),
sw AS (SELECT *, array_to_string(regexp_extract_all(lower(ss[1]), '[a-z0-9]+'), ' ') AS h, (conv_id + turn) % 4 AS form FROM st),
sx AS (SELECT *, coalesce(lead(h) OVER (PARTITION BY conv_id ORDER BY turn), 'the rest') AS n FROM sw),
lg AS (SELECT pid AS query_id, CASE form WHEN 0 THEN 'If ' || h || ' then what is ' || n || ' otherwise explain ' || h || '?' WHEN 1 THEN 'If it is not ' || h || ' then what is ' || n || ' otherwise explain ' || n || '?'
  WHEN 2 THEN 'If ' || h || ' ' || n || ', what is ' || n || '?' ELSE 'Compare ' || h || ' with ' || n || '?' END AS t FROM sx),
cm AS (SELECT query_id, trim(t) AS t, {" ".join(["CASE"] + [f"WHEN regexp_matches(trim(t), '{p}') THEN [trim(regexp_extract(trim(t), '{p}', 1)), trim(regexp_extract(trim(t), '{p}', 2))]" for p in A.COMPARE] + ["END"])} AS ab FROM lg),
pf AS (SELECT query_id, t, trim(regexp_extract(t, '{A.IF_THEN}', 1)) AS c, trim(regexp_extract(t, '{A.IF_THEN}', 2)) AS th, nullif(trim(regexp_extract(t, '{A.IF_THEN}', 3)), '') AS oth, ab FROM cm),
md AS (SELECT *, CASE WHEN c <> '' AND th <> '' THEN 'conditional' WHEN len({_CT.format('ab[1]')}) > 0 AND len({_CT.format('ab[2]')}) > 0 THEN 'compare' ELSE 'single' END AS mode FROM pf),
ps AS (SELECT query_id, mode, 1 AS step, CASE mode WHEN 'conditional' THEN 'condition' ELSE 'a' END AS role, CASE mode WHEN 'conditional' THEN c WHEN 'compare' THEN ab[1] ELSE trim(regexp_replace(t, '[?.,;\s]+$', '')) END AS clause FROM md
  UNION ALL SELECT query_id, mode, 2, CASE mode WHEN 'conditional' THEN 'then' ELSE 'b' END, CASE mode WHEN 'conditional' THEN th ELSE ab[2] END FROM md WHERE mode <> 'single' UNION ALL SELECT query_id, mode, 3, 'otherwise', oth FROM md WHERE mode = 'conditional' AND oth IS NOT NULL),
tk AS (SELECT pid, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM st), ts AS (SELECT count(*) AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM tk),
tq AS (SELECT query_id, step, term, count(*) AS qtf FROM (SELECT query_id, step, unnest(regexp_extract_all(lower(clause), '[a-z0-9]+')) AS term FROM ps) GROUP BY ALL),
tp AS (SELECT pid, dl, term, count(*) AS tf FROM (SELECT pid, len(toks) AS dl, unnest(toks) AS term FROM tk) GROUP BY ALL), tdf AS (SELECT term, count(*) AS df FROM tp GROUP BY 1),
hits AS (SELECT query_id, step, pid, round(sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS score FROM tq JOIN tp USING (term) JOIN tdf USING (term), ts GROUP BY ALL),
top1 AS (SELECT * FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, step ORDER BY score DESC, pid) = 1),
cand AS (SELECT query_id, step, top1.pid, {_CT.format('clause')} AS ct, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM top1 JOIN ps USING (query_id, step) JOIN st ON st.pid = top1.pid),
bs AS (SELECT query_id, step, pid, s, CASE WHEN len(ct) > 0 THEN round(len(list_intersect(ct, {_CT.format('s')})) / len(ct), 6) ELSE 0e0 END AS g FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, step ORDER BY CASE WHEN len(ct) > 0 THEN len(list_intersect(ct, {_CT.format('s')})) / len(ct) ELSE 0e0 END DESC, pos) = 1),
an AS (SELECT ps.*, pid, coalesce(g, 0e0) AS g, CASE WHEN g >= 5e-1 THEN 'answer' WHEN g >= 2e-1 THEN 'clarify' ELSE 'gap' END AS ak, CASE WHEN g >= 2e-1 THEN s || ' [1]' ELSE '' END AS answer, s FROM ps LEFT JOIN bs USING (query_id, step)),
cd AS (SELECT query_id, CASE WHEN ak = 'answer' THEN regexp_matches(answer, '{A.NEGATION.replace("'", "''")}') = regexp_matches(clause, '{A.NEGATION.replace("'", "''")}') END AS cond FROM an WHERE role = 'condition'),
rn AS (SELECT an.*, cond, (role = 'then' AND NOT coalesce(cond, FALSE)) OR (role = 'otherwise' AND coalesce(cond, TRUE)) AS skipped FROM an LEFT JOIN cd USING (query_id)),
ci AS (SELECT query_id, pid, row_number() OVER (PARTITION BY query_id ORDER BY min(step)) AS number FROM rn WHERE NOT skipped AND answer <> '' GROUP BY query_id, pid),
rs AS (SELECT rn.*, regexp_replace(answer, '\[1\]$', '[' || number || ']') AS txt FROM rn LEFT JOIN ci USING (query_id, pid) WHERE NOT skipped)"""


def asked_turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Passages of the conversations, and questions about their first sentences."""
    passages = wide_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("passage_id"), "text")
    c = wide_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("passage_id"), "conv_id", "turn", "text")
    # few bytes, but many patterns a row: a stated number of partitions is not made smaller, and the window below keeps it
    c = c.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "conv_id")
    c = c.withColumn("h", F.array_join(tokens(F.get(sentences("text"), 0)), " "))
    n = F.coalesce(F.lead("h").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("the rest"))
    t = F.concat
    form = (F.col("conv_id") + F.col("turn")) % 4
    c = c.withColumn("n", n)
    text = (
        F.when(form == 0, t(F.lit("If "), "h", F.lit(" then what is "), "n", F.lit(" otherwise explain "), "h", F.lit("?"))).when(form == 1, t(F.lit("If it is not "), "h", F.lit(" then what is "), "n", F.lit(" otherwise explain "), "n", F.lit("?")))
        .when(form == 2, t(F.lit("If "), "h", F.lit(" "), "n", F.lit(", what is "), "n", F.lit("?"))).otherwise(t(F.lit("Compare "), "h", F.lit(" with "), "n", F.lit("?")))
    )
    return passages, c.select(F.col("passage_id").alias("query_id"), text.alias("text"))


@query("plan_execution", "R25 R24 R43", f"""
WITH {_ASKED}, g AS (SELECT query_id, any_value(mode) AS mode, count(*) AS n, count(*) FILTER (ak = 'answer') AS na, min(step) FILTER (ak = 'gap') AS gap, min(step) FILTER (ak = 'clarify') AS clar, min(g) FILTER (ak = 'answer') AS low,
  bool_or(role = 'condition' AND NOT cond) AND NOT bool_or(role <> 'condition') AS no_branch,
  coalesce(string_agg(CASE WHEN ak <> 'answer' THEN NULL WHEN role = 'condition' THEN 'Condition “' || clause || '” ' || CASE WHEN cond THEN 'holds' ELSE 'does not hold' END || ' based on the evidence: ' || txt
    WHEN mode = 'compare' THEN upper(clause[1]) || clause[2:] || ': ' || txt ELSE txt END, ' ' ORDER BY step), '') AS whole, coalesce(string_agg(txt, ' ' ORDER BY step) FILTER (ak = 'answer' AND role <> 'condition'), '') AS partial FROM rs GROUP BY query_id),
o AS (SELECT g.*, CASE WHEN gap IS NOT NULL THEN 'gap' WHEN clar IS NOT NULL THEN 'clarify' WHEN na > 0 THEN 'answer' ELSE 'gap' END AS kind, CASE WHEN na > 0 THEN round(low * na / n, 3) ELSE 0e0 END AS cf FROM g)
SELECT o.query_id, o.mode, kind, coalesce(gap, clar)::INTEGER AS gap_step, CASE WHEN kind <> 'answer' THEN least(cf, round(coalesce(low, 0e0) * 5e-1, 3)) ELSE cf END AS confidence, o.n::BIGINT AS steps_asked,
  coalesce((SELECT string_agg(pid, ',' ORDER BY number) FROM ci WHERE ci.query_id = o.query_id), '') AS cited,
  md5(CASE kind WHEN 'gap' THEN trim(CASE WHEN partial <> '' THEN 'Partial result. ' || partial || ' ' ELSE '' END || 'Step ' || gap || ' (“' || x.clause || '”) lacked evidence: ' || x.txt)
    WHEN 'clarify' THEN trim('Step ' || clar || ' (“' || x.clause || '”) needs clarification: ' || x.txt) ELSE whole || CASE WHEN no_branch THEN ' No alternative branch was given for this case.' ELSE '' END END) AS text_md5
FROM o LEFT JOIN (SELECT query_id, step, clause, coalesce(txt, '') AS txt FROM rs) x ON x.query_id = o.query_id AND x.step = coalesce(gap, clar)
""")
def plan_execution(spark: SparkSession, sf: str) -> DataFrame:
    passages, asked = asked_turns(spark, sf)
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    public = F.array(F.lit("public"))
    full = 1 << 15  # turns are short, and every shard meets all questions: as few shards as there can be
    turns = passages.select(F.lit("t1").alias("tenant"), "passage_id", "text", public.alias("acl")).repartition(max(1, -(-passages.count() // full)))
    search.add_segment(turns, path, shard_passages=full)

    def ask(steps: DataFrame) -> DataFrame:
        """The best sentence of the best passage; how much of the clause it covers decides what kind of answer it is."""
        s = steps.withColumn("key", F.struct("query_id", "step"))
        hits = search.search(spark, path, s.select(F.to_json("key").alias("query_id"), F.lit("t1").alias("tenant"), "text", public.alias("accessible")), 1)
        hits = hits.select(F.from_json("query_id", "query_id long, step int").alias("key"), "passage_id").select("key.*", "passage_id")
        c = steps.join(hits, ["query_id", "step"]).join(passages.withColumnRenamed("text", "found"), "passage_id")
        c = c.select("query_id", "step", "passage_id", content_tokens("text").alias("ct"), F.posexplode(sentences("found")).alias("pos", "s"))
        covers = F.when(F.size("ct") > 0, F.size(F.array_intersect("ct", content_tokens("s"))) / F.size("ct")).otherwise(0.0)
        best = c.groupBy("query_id", "step", "passage_id").agg(F.max_by(F.struct("s", covers.alias("g")), F.struct(covers, -F.col("pos"))).alias("b"))
        g = F.round(F.coalesce("b.g", F.lit(0.0)), 6)
        kind = F.when(g >= 0.5, "answer").when(g >= 0.2, "clarify").otherwise("gap")
        told = kind != "gap"
        cites = F.when(told, F.array(F.struct(F.lit(1).alias("n"), F.col("passage_id")))).otherwise(F.array())
        return steps.join(best, ["query_id", "step"], "left").select(
            "query_id", "step", kind.alias("answer_kind"), g.alias("grounding"), g.alias("confidence"), F.when(told, F.concat("b.s", F.lit(" [1]"))).otherwise("").alias("answer"), cites.alias("citations"),
        )

    out = execution.execute(A.plan_questions(asked), ask)
    n = out["steps"].groupBy("query_id").agg(F.count_if(~F.col("skipped")).alias("steps_asked"))
    cited = out["citations"].groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "passage_id"))), lambda x: x["passage_id"].cast("string")), ",").alias("cited"))
    done = out["answers"].join(n, "query_id").join(cited, "query_id", "left")
    return done.select("query_id", "mode", "kind", "gap_step", "confidence", "steps_asked", F.coalesce("cited", F.lit("")).alias("cited"), F.md5("final_text").alias("text_md5"))


@query("plan_outcome", "R43", """
WITH e AS (SELECT user_id AS query_id, event_id AS step, CASE WHEN event_id % 3 = 0 THEN 'condition' ELSE 'lookup' END AS kind, CASE WHEN event_type = 'error' AND value > 60 THEN 'gap' WHEN event_type = 'signup' AND value > 60 THEN 'clarify' ELSE 'answer' END AS ak, round(least(1e0, value / 1e2), 3) AS c, CASE WHEN value > 5 THEN TRUE END AS cond FROM events WHERE event_type <> 'view'),
g AS (SELECT query_id, min(step) FILTER (ak = 'gap') AS gap, min(step) FILTER (ak = 'clarify') AS clar, min(step) FILTER (kind = 'condition' AND ak = 'answer' AND cond IS NULL) AS und, min(c) FILTER (ak = 'answer') AS low, count(*) FILTER (ak = 'answer') AS na, count(*) AS n FROM e GROUP BY 1),
k AS (SELECT *, CASE WHEN gap IS NOT NULL THEN 'gap' WHEN clar IS NOT NULL OR und IS NOT NULL THEN 'clarify' WHEN na > 0 THEN 'answer' ELSE 'gap' END AS kind, CASE WHEN na > 0 THEN round(low * na / n, 3) ELSE 0e0 END AS cf FROM g)
SELECT query_id, kind, coalesce(gap, clar, und) AS gap_step, CASE WHEN kind <> 'answer' THEN least(cf, round(coalesce(low, 0e0) * 5e-1, 3)) ELSE cf END AS confidence FROM k
""")
def plan_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type <> 'view'")
    r = e.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 == 0, "condition").otherwise("lookup").alias("kind"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), "gap").when((F.col("event_type") == "signup") & (F.col("value") > 60), "clarify").otherwise("answer").alias("answer_kind"),
        F.round(F.least(F.lit(1.0), F.col("value") / 100.0), 3).alias("confidence"), F.when(F.col("value") > 5, True).alias("condition"), F.lit(False).alias("skipped"),
    )
    return A.finalise(r)


@query("citation_numbers", "", """
SELECT user_id AS query_id, json_extract_string(props, '$.k')::BIGINT AS passage_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id))::INTEGER AS number FROM events GROUP BY 1, 2
""")
def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.get_json_object("props", "$.k").cast("long").alias("passage_id"), F.col("event_id").alias("step"), F.lit(0).alias("pos"))
    return A.renumber_citations(e)


@query("keep_cited", "R30")
def keep_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Turn texts as draft answers: every third sentence break gets a citation mark."""
    d = wide_table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.regexp_replace("text", r"\.\n", " [1].\n```\ncode\n```\n").alias("text"), F.lit(2).alias("n_citations"))
    return A.keep_cited(d)


@query("governance_line", "R39 R9 J14", f"""
WITH {_SEL}, d AS (SELECT doc_id, source, 1700000000000 + n_chars * 1000000 AS ing, coalesce(l.quality = 1, FALSE) AS au FROM documents LEFT JOIN labels l USING (doc_id))
SELECT query_id AS answer_id, d.doc_id AS document_id, d.source AS source_kind, CASE WHEN au THEN 'authoritative' ELSE 'cited' END AS authority, strftime(make_timestamp(ing * 1000), '%Y-%m-%d') AS freshness, 1710000000000 - ing > 90::BIGINT * 86400000 AS stale FROM sel JOIN d USING (doc_id) WHERE pick = 1
""")
def governance_line(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("document_id", "source", (F.lit(1700000000000) + F.col("n_chars") * 1000000).alias("ingested_at"))
    au = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), (F.col("quality") == 1).alias("authoritative"))
    c = selected(spark, sf).select(F.col("query_id").alias("answer_id"), "document_id", F.col("pick").alias("pos"))
    return A.governance_line(c, d.join(au, "document_id", "left"), 1710000000000)


_CITED = f"""{_SEL}, ov AS (SELECT DISTINCT source, (CAST(substr(source, 4) AS INTEGER) % 5 + 1) AS rank FROM documents WHERE lang = 'de'),
ci AS (SELECT query_id AS answer_id, sel.doc_id AS document_id, sel.source, coalesce(ov.rank, 5) AS rank, coalesce(l.quality = 1 AND l.toxic = 0, FALSE) AS au, pick FROM sel LEFT JOIN ov USING (source) LEFT JOIN labels l USING (doc_id))"""


def cited(spark: SparkSession, sf: str) -> DataFrame:
    from .retrieval import _ranks

    au = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("authoritative"))
    s = selected(spark, sf).join(_ranks(spark, sf).select("source", "rank"), "source", "left").join(au, "document_id", "left")
    return s.select(F.col("query_id").alias("answer_id"), "document_id", "source", "rank", F.coalesce("authoritative", F.lit(False)).alias("authoritative"), F.col("pick").alias("pos"))


@query("best_cited", "R9", f"""
WITH {_CITED} SELECT answer_id, arg_min(document_id, (NOT au, rank, pick)) AS document_id, count(*)::BIGINT AS cited FROM ci GROUP BY 1
""")
def best_cited(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.best_cited(cited(spark, sf)).select("answer_id", "document_id", "cited")


@query("authority_conflicts", "J14", f"""
WITH {_CITED} SELECT x.answer_id, x.document_id AS a, y.document_id AS b, CASE WHEN (NOT x.au, x.rank, x.pick) <= (NOT y.au, y.rank, y.pick) THEN x.document_id ELSE y.document_id END AS preferred
FROM ci x JOIN ci y ON x.answer_id = y.answer_id AND x.pick < y.pick AND x.source <> y.source AND (x.rank <> y.rank OR x.au <> y.au)
""")
def authority_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.authority_conflicts(cited(spark, sf))


@query("fuzzy_names", "J17")
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    al = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("alias")).distinct()
    q = wide_table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("where is the "), F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit(" of "), "p_brand").alias("text"))
    return names.resolve_names(q, al).withColumn("options", F.array_join("options", ","))
