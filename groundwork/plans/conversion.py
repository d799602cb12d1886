"""Conversion, chunking, typing and language queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lang as L
from ..functions.text import sentences, tokens
from ..operators import convert as K
from ..operators import sheets as S
from ..registry import query
from ..session import table, wide_table
from .common import documents

_EXT = "csv tsv xlsx transcript ipynb py sh ocr.txt png docx pdf pptx html jira.json txt md doc htm js svg".split()
_EXTL = "[" + ",".join(f"'{x}'" for x in _EXT) + "]"


@query("route_classify", "C1 C2", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE p_type WHEN 'ECONOMY' THEN 'text/csv' WHEN 'SMALL' THEN 'image/png' WHEN 'LARGE' THEN 'text/html; charset=utf-8' WHEN 'MEDIUM' THEN 'application/x-acme-passages+json' ELSE 'audio/mpeg' END ELSE '' END AS mime,
  CASE WHEN p_partkey % 7 = 0 THEN 'confluence://S/' ELSE 'file://' END || p_partkey || '.' || ({_EXTL})[p_size % {len(_EXT)} + 1] || '?v=1' AS uri FROM part),
m AS (SELECT *, trim(split_part(lower(mime), ';', 1)) AS m, split_part(lower(uri), '?', 1) AS u FROM p),
r AS (SELECT *, CASE WHEN u LIKE '%.jira.json' THEN 'jira' WHEN m LIKE '%passages+json' THEN 'passages' WHEN m = 'text/csv' OR u LIKE '%.csv' OR u LIKE '%.tsv' THEN 'table' WHEN u LIKE '%.xlsx' THEN 'spreadsheet' WHEN m LIKE '%audio%' OR u LIKE '%.transcript' THEN 'transcript'
 WHEN u LIKE '%.ipynb' THEN 'notebook' WHEN regexp_matches(u, '\\.(py|sh|js)$') THEN 'code' WHEN u LIKE '%.ocr.txt' THEN 'scan' WHEN m LIKE 'image/%' OR regexp_matches(u, '\\.(png|svg)$') THEN 'image' WHEN u LIKE '%.docx' THEN 'docx'
 WHEN regexp_matches(u, '\\.(pdf|pptx|doc)$') THEN 'office' WHEN m = 'text/html' OR regexp_matches(u, '\\.(html|htm)$') THEN 'html' ELSE 'text' END AS route FROM m)
SELECT p_partkey, route, CASE WHEN u LIKE 'confluence://%' THEN 'confluence' WHEN route = 'jira' THEN 'jira' WHEN route IN ('table', 'spreadsheet') THEN 'table' WHEN route = 'image' THEN 'image' WHEN route IN ('code', 'notebook') THEN 'code' ELSE 'document' END AS kind FROM r
""")
def route_classify(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    t = F.col("p_type")
    mime = F.when(F.col("p_size") % 3 == 0, F.when(t == "ECONOMY", "text/csv").when(t == "SMALL", "image/png").when(t == "LARGE", "text/html; charset=utf-8").when(t == "MEDIUM", "application/x-acme-passages+json").otherwise("audio/mpeg")).otherwise("")
    uri = F.concat(F.when(F.col("p_partkey") % 7 == 0, "confluence://S/").otherwise("file://"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in _EXT]), F.col("p_size") % len(_EXT) + 1), F.lit("?v=1"))
    return p.select("p_partkey", K.classify(mime, uri).alias("route"), K.source_kind(mime, uri).alias("kind"))


@query("html_paragraphs", "C4")
def html_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return K.html_passages(wide_table(spark, sf, "pages").select("page_id", "url", "html"))


_TR = """
t AS (SELECT conv_id, turn, text, '[' || lpad((turn % 60)::VARCHAR, 2, '0') || ':' || lpad((conv_id % 60)::VARCHAR, 2, '0') || '] ' AS stamp, string_split(text, e'\\n') AS ls FROM conversations)"""


@query("transcript_lines", "C5", f"""
WITH {_TR}, l AS (SELECT conv_id, turn, stamp, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM t)
SELECT conv_id, turn, i::INTEGER AS line, (turn % 60 * 60 + conv_id % 60)::INTEGER AS start_s, (turn % 60 * 60 + conv_id % 60 + 10)::INTEGER AS end_s, md5(trim(line)) AS text_md5 FROM l WHERE i % 2 = 0
""")
def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = wide_table(spark, sf, "conversations")
    stamp = F.concat(F.lit("["), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("conv_id") % 60).cast("string"), 2, "0"), F.lit("] "))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(stamp, F.trim(x))).otherwise(F.concat(F.lit("- "), x))), "\n")
    t = K.transcript_passages(c.select("conv_id", "turn", body.alias("text")))
    return t.select("conv_id", "turn", "line", "start_s", "end_s", F.md5("passage").alias("text_md5"))


@query("scan_paragraphs", "C6", r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, e'\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents), e AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS i FROM p)
SELECT doc_id, i::BIGINT AS pos, (i // 4 + 1)::BIGINT AS page, '72,' || (100 + i % 4 * 120) || ',520,90' AS bbox FROM e
""")
def scan_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    s = K.scan_passages(documents(spark, sf).select("doc_id", "text"), "text", r"\n")
    return s.select("doc_id", "pos", "page", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",").alias("bbox"))


def issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as issues; the customer is the assignee, sibling orders of the customer are not gathered."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    s = lambda x: F.col(x).cast("string")
    return j.select(
        F.concat(F.lit("ORD-"), s("o_orderkey")).alias("key"), F.concat(F.lit("Order of "), "c_name").alias("summary"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.lit("Task").alias("type"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("assignee"), F.array(F.lower("c_mktsegment")).alias("labels"),
        F.when(F.col("o_orderstatus") == "P", F.struct(F.concat(F.lit("S"), F.year("o_orderdate").cast("string")).alias("name"), F.lit("active").alias("state"))).alias("sprint"),
        F.lit("").alias("parent"), F.concat(F.lit("First part\n\nSecond part of "), s("o_orderkey")).alias("description"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("blocks").alias("direction"), F.lit("Blocks").alias("type"), F.concat(F.lit("ORD-"), (F.col("o_orderkey") + 1).cast("string")).alias("key"), F.lit("next").alias("summary")))).otherwise(F.array().cast("array<struct<direction:string,type:string,key:string,summary:string>>")).alias("links"),
        F.array(F.struct(F.lit("1").alias("id"), F.lit("ann").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.lit("  done ").alias("body")), F.struct(F.lit("2").alias("id"), F.lit("bob").alias("author"), F.lit("x").alias("created"), F.lit(" ").alias("body"))).alias("comments"),
    )


@query("issue_passages", "C7", """
WITH i AS (SELECT 'ORD-' || o_orderkey AS key, o_orderkey AS k, o_orderstatus AS st, o_orderdate, 'Order of ' || c_name AS summary, 'Status: ' || o_orderstatus || '; Priority: ' || o_orderpriority || '; Type: Task' || CASE WHEN c_acctbal > 0 THEN '; Assignee: ' || c_name ELSE '' END ||
  '; Labels: ' || lower(c_mktsegment) || CASE WHEN o_orderstatus = 'P' THEN '; Sprint: S' || year(o_orderdate) || ' (active)' ELSE '' END AS facts FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT key, 1 AS page, 1 AS paragraph, 'summary' AS field, '[' || key || '] ' || summary || e'\\n' || facts AS passage FROM i UNION ALL SELECT key, 1, 2, 'description', 'First part' FROM i UNION ALL SELECT key, 1, 3, 'description', 'Second part of ' || k FROM i
UNION ALL SELECT key, 1, 4, 'links', key || ' links: blocks ORD-' || (k + 1) || ' (next)' FROM i WHERE st = 'F' UNION ALL SELECT key, 2, 1, 'comment', 'Comment by ann on ' || strftime(o_orderdate, '%Y-%m-%d') || ': done' FROM i
""")
def issue_passages(spark: SparkSession, sf: str) -> DataFrame:
    return K.issue_passages(issue_rows(spark, sf))


@query("image_passages", "C8 S26", """
WITH p AS (SELECT p_partkey AS doc_id, p_name, p_brand, p_type, p_size FROM part)
SELECT doc_id, 'fig.png' AS name, 0 AS pos, 'caption' AS field, 'Figure of ' || p_name AS passage FROM p UNION ALL SELECT doc_id, 'fig.png', 1, 'ocr', p_brand FROM p UNION ALL SELECT doc_id, 'fig.png', 2, 'ocr', 'size ' || p_size FROM p
UNION ALL SELECT doc_id, 'fig.png', 3, 'description', 'Kind: chart. Entities: ' || p_brand || ', ' || p_type || '. ' || CASE WHEN p_size > 25 THEN 'Components: a, b. ' ELSE '' END || 'Chart type: bar. Readings: size=' || p_size || '. ' || CASE WHEN p_size > 10 THEN 'Text present.' ELSE 'No text visible.' END FROM p
""")
def image_passages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    none = F.array().cast("array<string>")
    im = p.select(
        F.col("p_partkey").alias("doc_id"), F.lit("fig.png").alias("name"), F.concat(F.lit("Figure of "), "p_name").alias("caption"), (F.col("p_size") > 10).alias("text_present"), F.array("p_brand", "p_type").alias("entities"),
        F.lit("chart").alias("kind"), F.struct(F.when(F.col("p_size") > 25, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("components"), none.alias("connections")).alias("diagram"),
        F.struct(F.lit("bar").alias("type"), none.alias("series"), F.array(F.concat(F.lit("size="), size)).alias("readings")).alias("chart"), F.concat("p_brand", F.lit("\n\nsize "), size).alias("ocr_text"),
    )
    return K.image_passages(im)


# Sheets: orders as text, one sheet per priority. All but the LOW sheet start with a header row.
def order_sheets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pct = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%"))
    rows = o.select(
        F.col("o_orderpriority").alias("sheet"), (F.col("o_orderkey") + 1).alias("row"),
        F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.format_number("o_totalprice", 2), pct, F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))).alias("cells"),
    )
    head = o.select("o_orderpriority").distinct().where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("sheet"), F.lit(0).cast("long").alias("row"), F.array(F.lit("key"), F.lit("order  state"), F.lit("total"), F.lit("share"), F.lit("Total")).alias("cells"))
    return S.cells(rows.unionByName(head), "sheet", "row", "cells")


@query("sheet_headers", "C14 C15", """
WITH s AS (SELECT DISTINCT o_orderpriority AS sheet_id FROM orders) SELECT sheet_id, unnest([0, 1, 2, 3, 4]) AS col, CASE WHEN sheet_id = '5-LOW' THEN unnest(['col1','col2','col3','col4','col5']) ELSE unnest(['key','order state','total','share','Total_2']) END AS name, sheet_id <> '5-LOW' AS had_header FROM s
""")
def sheet_headers(spark: SparkSession, sf: str) -> DataFrame:
    c = order_sheets(spark, sf)
    h = S.detect_header(c)
    return S.column_names(c, h).join(h.select("sheet_id", "had_header"), "sheet_id")


@query("sheet_types", "C16 C17 C18", """
WITH s AS (SELECT o_orderpriority AS sheet_id, min(o_orderkey)::DOUBLE AS k0, max(o_orderkey)::DOUBLE AS k1, min(round(o_totalprice, 2)) AS t0, max(round(o_totalprice, 2)) AS t1, min(o_custkey % 100) / 1e2 AS p0, max(o_custkey % 100) / 1e2 AS p1,
  min(o_custkey) FILTER (o_orderstatus <> 'P')::DOUBLE AS c0, max(o_custkey) FILTER (o_orderstatus <> 'P')::DOUBLE AS c1 FROM orders GROUP BY 1)
SELECT sheet_id, 0 AS col, 'int' AS type, k0 AS min, k1 AS max FROM s UNION ALL SELECT sheet_id, 1, 'text', NULL, NULL FROM s UNION ALL SELECT sheet_id, 2, 'real', t0, t1 FROM s UNION ALL SELECT sheet_id, 3, 'real', p0, p1 FROM s UNION ALL SELECT sheet_id, 4, 'int', c0, c1 FROM s
""")
def sheet_types(spark: SparkSession, sf: str) -> DataFrame:
    c = order_sheets(spark, sf)
    b = S.body(c, S.detect_header(c))
    t = S.column_types(b)
    return t.join(S.numeric_ranges(b, t), ["sheet_id", "col"], "left")


@query("sheet_row_passages", "C19", """
SELECT o_orderpriority AS sheet_id, o_orderkey + 1 AS row, CASE WHEN o_orderpriority = '5-LOW' THEN 'col1: ' || o_orderkey || '; col2: ' || o_orderstatus || '; col3: ' || format('{:,.2f}', o_totalprice) || '; col4: ' || (o_custkey % 100) || '%' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '; col5: ' || o_custkey END
 ELSE 'key: ' || o_orderkey || '; order state: ' || o_orderstatus || '; total: ' || format('{:,.2f}', o_totalprice) || '; share: ' || (o_custkey % 100) || '%' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '; Total_2: ' || o_custkey END END AS passage FROM orders
""")
def sheet_row_passages(spark: SparkSession, sf: str) -> DataFrame:
    c = order_sheets(spark, sf)
    h = S.detect_header(c)
    return S.row_passages(S.body(c, h), S.column_names(c, h))


@query("sheet_summary", "C20", """
WITH s AS (SELECT o_orderpriority AS sheet_id, count(*) AS n, min(o_orderkey) AS k0, max(o_orderkey) AS k1, min(o_custkey) AS c0, max(o_custkey) AS c1 FROM orders GROUP BY 1)
SELECT sheet_id, 'Sheet ''' || sheet_id || ''' of orders: ' || n || ' rows × 2 columns (key, customer). Numeric ranges: key min ' || k0 || ' max ' || k1 || '; customer min ' || c0 || ' max ' || c1 || '.' AS summary FROM s
""")
def sheet_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderpriority").alias("sheet"), (F.col("o_orderkey") + 1).alias("row"), F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("cells"))
    head = o.select(F.col("o_orderpriority").alias("sheet")).distinct().select("sheet", F.lit(0).cast("long").alias("row"), F.array(F.lit("key"), F.lit("customer")).alias("cells"))
    c = S.cells(rows.unionByName(head), "sheet", "row", "cells")
    h = S.detect_header(c)
    b = S.body(c, h)
    return S.sheet_summary(b, S.column_names(c, h), S.numeric_ranges(b, S.column_types(b)), "orders")


_TQ = "WITH x AS (SELECT o_orderpriority AS p, sum(o_totalprice) AS s FROM t GROUP BY o_orderpriority) SELECT p, round(s, 2) AS total FROM x WHERE s > (SELECT avg(o_totalprice) FROM t) ORDER BY p"


@query("table_query", "C22", _TQ.replace("FROM t", "FROM orders"))
def table_query(spark: SparkSession, sf: str) -> DataFrame:
    return S.table_query(table(spark, sf, "orders"), _TQ)


@query("outline", "C23", r"""
WITH l AS (SELECT doc_id, string_split(text, e'\n') AS ls FROM documents),
h AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^\s{0,3}#{1,6}\s+(.*\S)\s*$') THEN regexp_extract(x, '^\s{0,3}#{1,6}\s+(.*\S)\s*$', 1)
  WHEN upper(regexp_replace(x, '^\s+|\s+$', '', 'g')) = regexp_replace(x, '^\s+|\s+$', '', 'g') AND regexp_matches(x, '\p{L}') AND len(regexp_split_to_array(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+')) <= 8 THEN regexp_replace(x, '^\s+|\s+$', '', 'g') END) AS hs, ls FROM l),
b AS (SELECT doc_id, list_distinct(list_filter(hs, lambda x: x IS NOT NULL)) AS heads, array_to_string(list_filter(ls, lambda x, i: hs[i] IS NULL), e'\n') AS body FROM h),
e AS (SELECT doc_id, heads, list_distinct(list_filter(regexp_extract_all(body, '[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*'), lambda x: contains(x, ' ') OR x NOT IN ('The','This','That','These','Those','A','An','In','On','At','For','And','But','Or','If','When','While','It','We','You','They','He','She'))) AS ents,
 list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(body, e'\n', ' '), '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 2 AND regexp_matches(s, '\p{L}')) AS cl FROM b)
SELECT doc_id, len(heads)::INTEGER AS n_headings, len(ents)::INTEGER AS n_entities, len(cl)::INTEGER AS n_claims, md5(cl[1]) AS first_claim, md5(array_to_string(list_sort(ents), ',')) AS entities_md5 FROM e
""")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    o = K.outline(documents(spark, sf).select("doc_id", "text"))
    return o.select("doc_id", F.size("headings").alias("n_headings"), F.size("entities").alias("n_entities"), F.size("claims").alias("n_claims"), F.md5(F.try_element_at("claims", F.lit(1))["text"]).alias("first_claim"), F.md5(F.array_join(F.array_sort("entities"), ",")).alias("entities_md5"))


_FR = "('" + "','".join(L.FR) + "')"
_ES = "('" + "','".join(L.ES) + "')"


@query("lang_detect", "C24", f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents),
v AS (SELECT doc_id, text, len(w) AS n, len(list_filter(w, lambda x: x IN {_FR})) + CASE WHEN regexp_matches(text, '[çœàèù]') THEN 1 ELSE 0 END AS fr, len(list_filter(w, lambda x: x IN {_ES})) + CASE WHEN regexp_matches(text, '[ñ¿¡]') THEN 2 ELSE 0 END AS es FROM w)
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') THEN 'ja' WHEN n = 0 THEN 'en' WHEN es > fr AND es >= 1 THEN 'es' WHEN fr > es AND fr >= 1 THEN 'fr' ELSE 'en' END AS detected FROM v
""")
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", L.detect_language(F.col("text")).alias("detected"))


def _lexmap(lex: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lex.items()) + "}"


@query("query_translation", "C25", rf"""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN 'fr' WHEN conv_id % 3 = 1 THEN 'es' ELSE 'en' END AS code, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations),
m AS (SELECT *, CASE code WHEN 'fr' THEN array_to_string(list_filter(list_transform(w, lambda x: coalesce({_lexmap(L.LEX_FR)}[x], x)), lambda x: x <> ''), ' ') WHEN 'es' THEN array_to_string(list_filter(list_transform(w, lambda x: coalesce({_lexmap(L.LEX_ES)}[x], x)), lambda x: x <> ''), ' ') ELSE text END AS t FROM c)
SELECT conv_id, turn, md5(coalesce(nullif(trim(t), ''), text)) AS translated_md5 FROM m
""")
def query_translation(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("conv_id") % 3 == 0, "fr").when(F.col("conv_id") % 3 == 1, "es").otherwise("en")
    return wide_table(spark, sf, "conversations").select("conv_id", "turn", F.md5(L.translate_query(F.col("text"), code)).alias("translated_md5"))


_FORMS = ["How many items in ", "Compare with the other ", "Which kinds of ", "hello ", "Is there any example of ", "verify the commit for ", ""]
_QSQL = "q AS (SELECT conv_id, turn, (['" + "','".join(_FORMS) + f"'])[(conv_id + turn) % {len(_FORMS)} + 1] || text AS t FROM conversations)"


def question_log(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns turned into questions of every form."""
    pre = F.element_at(F.array(*[F.lit(x) for x in _FORMS]), ((F.col("conv_id") + F.col("turn")) % len(_FORMS) + 1).cast("int"))
    return wide_table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(pre, "text").alias("question"))


@query("question_intent", "C29 P9 P10", rf"""
WITH {_QSQL}, l AS (SELECT *, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS l FROM q)
SELECT conv_id, turn, CASE WHEN l = '' OR regexp_matches(l, '^(hi|hey|hello|thanks|thank you|good (morning|afternoon|evening))\b') OR (len(list_filter(regexp_split_to_array(l, '\s+'), lambda w: w <> '')) <= 2 AND NOT contains(t, '?')) THEN 'greeting'
 WHEN regexp_matches(l, '\b(how many|how much|number of|count of)\b') THEN 'count' WHEN regexp_matches(l, '\b(vs|versus|compare|comparison|compared to|difference between|better than)\b') THEN 'comparison' WHEN regexp_matches(l, '\b(list|which|types of|kinds of|examples of|what are|name the)\b') THEN 'list' ELSE 'definition' END AS intent,
 regexp_matches(l, '\b(has|have)\s+(anyone|we|someone|any\s?one)\b|\b(is|are)\s+there\b|\bdo\s+we\s+have\b|\bcan\s+i\s+(find|reuse|use|get)\b|\bwhere\s+(can|do)\s+i\s+find\b|\bfind\s+(me\s+)?(a|an|the|some|any)\b|\blook(ing)?\s+for\b|\bsearch\s+for\b|\breus(e|able)\b|\bexample[s]?\s+of\b|\bexisting\b|\bany\s+(code|script|module|library|example)\b') AS discovery,
 regexp_matches(l, '\b(verif(?:y|ies|ied|ication)|cross[- ]?check|corroborate|reconcile|double[- ]?check|confirm(?:ed|s)?|really (?:done|complete)|actually (?:done|complete))\b') AND (regexp_matches(t, '\b[A-Z][A-Z0-9]{{1,9}}-\d+\b') OR regexp_matches(l, '\b(repo|repository|code|commit|commits|pull request|prs?|github)\b')) AS verification FROM l
""")
def question_intent(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.graph import wants_verification
    from ..operators.retrieval import is_discovery

    q = question_log(spark, sf)
    return q.select("conv_id", "turn", L.question_intent(F.col("question")).alias("intent"), is_discovery(F.col("question")).alias("discovery"), wants_verification(F.col("question")).alias("verification"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("sentence_dedupe", "C27", rf"""
WITH s AS (SELECT doc_id, {_SENT.format('text')} AS ss FROM documents), k AS (SELECT doc_id, ss, list_transform(ss, lambda s: array_to_string(regexp_extract_all(regexp_replace(lower(s), '\[\d+\]', ' ', 'g'), '[a-z0-9]+'), ' ')) AS ks FROM s)
SELECT doc_id, len(ss)::INTEGER AS sentences, len(list_distinct(list_filter(ks, lambda x: x <> '')))::INTEGER AS kept, md5(array_to_string(list_filter(ss, lambda s, i: ks[i] <> '' AND list_position(ks, ks[i]) = i), '|')) AS kept_md5 FROM k
""")
def sentence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", sentences("text").alias("ss"))
    u = d.select("doc_id", "ss", L.dedupe_sentences(F.col("ss")).alias("u"))
    return u.select("doc_id", F.size("ss").alias("sentences"), F.size("u").alias("kept"), F.md5(F.array_join("u", "|")).alias("kept_md5"))


@query("entity_guard", "C28", rf"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ev FROM conversations),
s AS (SELECT conv_id, turn, {_SENT.format('text')} AS ss, regexp_extract_all(lower(ev), '[a-z0-9]+') AS ev FROM p WHERE ev IS NOT NULL),
u AS (SELECT conv_id, turn, ev, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s),
w AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(regexp_replace(s, '\[\d+\]', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+'), lambda x: trim(x, '"''.,;:!?()[]{{}}')) AS ws FROM u),
g AS (SELECT conv_id, turn, i, s, len(list_filter(ws, lambda c, j: (regexp_matches(c, '\p{{Nd}}') OR (length(c) >= 2 AND regexp_matches(c, '^\p{{Lu}}.*\p{{Lu}}')) OR (j > 1 AND regexp_matches(c, '^\p{{Lu}}')))
  AND regexp_replace(lower(c), '[^a-z0-9]', '', 'g') <> '' AND NOT list_contains(ev, regexp_replace(lower(c), '[^a-z0-9]', '', 'g')))) = 0 AS ok FROM w)
SELECT conv_id, turn, count(*)::INTEGER AS sentences, (count(*) FILTER (ok))::INTEGER AS kept, md5(coalesce(string_agg(s, '|' ORDER BY i) FILTER (ok), '')) AS kept_md5 FROM g GROUP BY ALL
""")
def entity_guard(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = wide_table(spark, sf, "conversations").withColumn("ev", F.lag("text").over(w)).where("ev is not null")
    c = c.select("conv_id", "turn", sentences("text").alias("ss"), tokens("ev").alias("ev"))
    g = c.select("conv_id", "turn", "ss", L.entity_guard(F.col("ss"), F.col("ev")).alias("k"))
    return g.select("conv_id", "turn", F.size("ss").alias("sentences"), F.size("k").alias("kept"), F.md5(F.array_join("k", "|")).alias("kept_md5"))


@query("pre_chunked", "S18", r"""
WITH d AS (SELECT doc_id, lang, text, list_filter(string_split(text, e'\n'), lambda x: trim(x) <> '') AS ls FROM documents),
j AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM d WHERE lang <> 'en')
SELECT doc_id, i::INTEGER AS i, CASE WHEN i % 2 = 0 THEN 'symbol_line' ELSE 'page_paragraph' END AS kind, CASE WHEN i % 2 = 0 THEN '7' ELSE '1' END AS page, md5(trim(t)) AS text_md5 FROM j
UNION ALL SELECT doc_id, 0, 'page_paragraph', '1', md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) FROM d WHERE lang = 'en'
""")
def pre_chunked(spark: SparkSession, sf: str) -> DataFrame:
    ls = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    js = F.to_json(F.transform(ls, lambda x, i: F.struct(x.alias("text"), F.when(i % 2 == 0, "symbol_line").otherwise("no_such_kind").alias("kind"), F.when(i % 2 == 0, F.create_map(F.lit("page"), F.lit("7"))).alias("locator"))))
    d = documents(spark, sf).select("doc_id", F.when(F.col("lang") == "en", F.col("text")).otherwise(js).alias("body"))
    return K.pre_chunked(d).select("doc_id", "i", "kind", "page", F.md5("passage").alias("text_md5"))


@query("notebook_cells", "C12", r"""
WITH d AS (SELECT doc_id, list_filter(string_split(text, e'\n'), lambda x: trim(x) <> '') AS ls FROM documents), j AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM d)
SELECT doc_id, i::INTEGER AS cell, CASE WHEN i % 3 = 0 THEN 'code' ELSE 'prose' END AS kind, md5(CASE WHEN i % 3 = 0 THEN '# %% [cell ' || i || e']\n' || regexp_replace('x' || t, '\s+$', '') ELSE trim('x' || t) END) AS text_md5 FROM j
""")
def notebook_cells(spark: SparkSession, sf: str) -> DataFrame:
    ls = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cell = F.transform(ls, lambda x, i: F.struct(F.when((i + 1) % 3 == 0, "code").otherwise("markdown").alias("cell_type"), F.when(i % 2 == 0, F.to_json(F.array(F.lit("x"), x))).otherwise(F.concat(F.lit("x"), x)).alias("source")))
    body = F.to_json(F.struct(cell.alias("cells")))
    return K.notebook_cells(documents(spark, sf).select("doc_id", body.alias("body"))).select("doc_id", "cell", "kind", F.md5("passage").alias("text_md5"))
