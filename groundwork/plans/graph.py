"""Extraction and graph queries.

Supplier graph: an order is a passage of its customer's document and mentions the suppliers of its
lines; suppliers co-occur. Statements: short texts about customers and suppliers. Issues: orders,
named by order lines that play commits, pull requests and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import communities as M
from ..operators import extract as X
from ..operators import graph as G
from ..operators.lexicon import lexicon_join
from ..operators.quality import contradictions_by_hash
from ..registry import query
from ..session import cut_lineage, table
from .common import documents


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the part names, typed by whether they name a thing or a quality."""
    w = table(spark, sf, "part").select(F.posexplode(F.split(F.lower("p_name"), " ")).alias("i", "term"))
    return w.groupBy("term").agg(F.max(F.when(F.col("i") > 0, "Product").otherwise("Quality")).alias("type")).where(F.length("term") >= 3)


_LEX = """lex AS (SELECT term, CASE WHEN min(i) = 0 AND max(i) = 0 THEN 'Quality' WHEN max(i) > 0 AND min(i) > 0 THEN 'Product' ELSE 'Quality' END AS type FROM (
  SELECT unnest(string_split(lower(p_name), ' ')) AS term, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS i FROM part) WHERE length(term) >= 3 GROUP BY term)"""
_CAP = r"""cap AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g'),
   '\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,3})\b', 1))) AS phrase FROM documents),
capk AS (SELECT DISTINCT doc_id, lower(phrase) AS key FROM cap WHERE length(phrase) >= 3
  AND phrase NOT IN ('The','This','That','These','Those','It','A','An','In','On','For','To','And'))"""


@query("lexicon_mentions", "G1 J11", f"WITH {_LEX} SELECT doc_id AS passage_id, term AS key, type, 0.9::DOUBLE AS confidence FROM documents, lex WHERE contains(lower(text), term)")
def lexicon_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return X.lexicon_mentions(documents(spark, sf), lexicon(spark, sf))


@query("mentions", "G1 G2 G5", f"""
WITH {_LEX}, {_CAP}, u AS (SELECT doc_id, term AS key, 0.9::DOUBLE AS c FROM documents, lex WHERE contains(lower(text), term) UNION ALL SELECT doc_id, key, 0.5::DOUBLE FROM capk)
SELECT doc_id AS passage_id, key, max(c) AS confidence, max(c) < 55e-2 AS review FROM u GROUP BY ALL
""")
def mentions(spark: SparkSession, sf: str) -> DataFrame:
    m = X.mentions(documents(spark, sf), lexicon(spark, sf))
    return m.select("passage_id", "key", "confidence", (F.col("confidence") < X.REVIEW_BELOW).alias("review"))


@query("resolve_entities", "G6", f"""
WITH {_CAP} SELECT key, 'Concept' AS type, min(doc_id)::BIGINT AS first_passage, count(*)::BIGINT AS mentions, substr(sha256(key || chr(0) || 'Concept'), 1, 24) AS node_id FROM capk GROUP BY key
""")
def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    m = X.capitalised_mentions(documents(spark, sf))
    return X.resolve_entities(m.withColumn("arrival", F.col("passage_id")))


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with stated relations: one per customer, one per supplier."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("k"))
    c = c.select(F.col("c_custkey").alias("passage_id"), F.concat(F.col("c_mktsegment"), F.lit(" belongs to "), F.col("n_name"), F.lit(". "), F.col("c_name"), F.lit(" depends on "), F.col("c_mktsegment"), F.lit(".\nNothing here")).alias("text"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("k"))
    s = s.select((F.col("s_suppkey") + 1000000000).alias("passage_id"), F.concat(F.col("s_name"), F.lit(" conforms to ISO "), F.col("n_name"), F.lit("\n"), F.col("s_name"), F.lit(" verifies the parts of "), F.col("n_name")).alias("text"))
    return c.unionByName(s)


_NRM = r"array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[^A-Za-z0-9 ]', ' ', 'g')), '\s+'), lambda x: x <> '')[1:5], ' ')"
_REL = f"""st AS (SELECT c_custkey AS passage_id, 0 AS sentence, {_NRM.format('c_mktsegment')} AS src, 'belongs_to' AS relation, {_NRM.format('n_name')} AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_custkey, 1, {_NRM.format('c_name')}, 'depends_on', {_NRM.format('c_mktsegment')} FROM customer
 UNION ALL SELECT 1000000000 + s_suppkey, 0, {_NRM.format('s_name')}, 'complies_with', {_NRM.format("'ISO ' || n_name")} FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 1000000000 + s_suppkey, 1, {_NRM.format('s_name')}, 'verifies', {_NRM.format("'the parts of ' || n_name")} FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("stated_relations", "G3", f"WITH {_REL} SELECT passage_id::BIGINT AS passage_id, sentence::INTEGER AS sentence, src, relation, dst, 0.7::DOUBLE AS confidence FROM st")
def stated_relations(spark: SparkSession, sf: str) -> DataFrame:
    return X.relations(statements(spark, sf))


@query("contradictions", "G8", f"""
WITH {_REL}, o AS (SELECT *, passage_id * 10 + sentence AS arrival FROM st)
SELECT a.passage_id::BIGINT AS passage_id, a.src, a.relation, a.dst, (relation IN ('complies_with', 'belongs_to') AND EXISTS (SELECT 1 FROM o b WHERE b.src = a.src AND b.relation = a.relation AND b.dst <> a.dst AND b.arrival < a.arrival)) AS conflict FROM o a
""")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    r = X.relations(statements(spark, sf)).withColumn("arrival", F.col("passage_id") * 10 + F.col("sentence"))
    return X.contradiction_flags(r).select("passage_id", "src", "relation", "dst", "conflict")


_FLAGS = _REL + """, o AS (SELECT *, passage_id * 10 + sentence AS arrival FROM st),
flags AS (SELECT a.passage_id, relation IN ('complies_with', 'belongs_to') AND EXISTS (SELECT 1 FROM o b WHERE b.src = a.src AND b.relation = a.relation AND b.dst <> a.dst AND b.arrival < a.arrival) AS conflict FROM o a)"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    r = X.relations(statements(spark, sf)).withColumn("arrival", F.col("passage_id") * 10 + F.col("sentence"))
    return X.contradiction_flags(r)


@query("contradiction_hashes", "Q3", f"""
WITH {_FLAGS} SELECT sha256(n_name) AS content_hash, count(*)::BIGINT AS flags FROM flags JOIN customer ON c_custkey = passage_id JOIN nation ON c_nationkey = n_nationkey WHERE conflict GROUP BY 1
""")
def contradiction_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged statements per document, where a nation's customers are one document; suppliers' have no source."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.sha2("n_name", 256).alias("_hash"))
    source = table(spark, sf, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("passage_id"), F.array("_hash").alias("provenance"))
    return contradictions_by_hash(flagged(spark, sf).join(source, "passage_id", "left"))


@query("graph_counts", "G10", f"""
WITH {_FLAGS} SELECT (SELECT count(*) FROM (SELECT src FROM st UNION SELECT dst FROM st))::BIGINT AS nodes, count(*)::BIGINT AS edges, (count(*) FILTER (conflict))::BIGINT AS contradictions FROM flags
""")
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = cut_lineage(flagged(spark, sf))
    return G.graph_counts(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e)


@query("edge_weights", "G22", """
SELECT l_partkey AS src, l_suppkey AS dst, count(*)::BIGINT AS edges, round(sum(CASE WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax ELSE 1e0 END), 6) AS weight FROM lineitem GROUP BY ALL
""")
def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of part-supplier edges: a line's discount, else its tax, else one."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), G.edge_weight(F.col("l_discount"), F.col("l_tax")).alias("w"))
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 6).alias("weight"))


@query("concept_backfill", "G7", f"""
WITH {_REL}, ends AS (SELECT src AS key FROM st UNION SELECT dst FROM st) SELECT key, 'Concept' AS type FROM ends WHERE key NOT IN (SELECT lower(n_name) FROM nation)
""")
def concept_backfill(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nation").select(F.lower("n_name").alias("key"))
    return X.concept_backfill(nodes, X.relations(statements(spark, sf)))


@query("salience", "G4", """
WITH v(term, weight) AS (VALUES ('the', 0.1::DOUBLE), ('and', 0.2), ('on', 0.3), ('der', 0.4), ('le', 0.5), ('que', 0.6)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)
SELECT doc_id AS passage_id, term, round(count(*) * max(weight), 6) AS score FROM w JOIN v USING (term) GROUP BY ALL
""")
def salience(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.createDataFrame([("the", 0.1), ("and", 0.2), ("on", 0.3), ("der", 0.4), ("le", 0.5), ("que", 0.6)], "term string, weight double")
    return X.salience(documents(spark, sf), v)


def supplier_mentions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("passage_id"), F.col("l_suppkey").alias("node")).distinct()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("passage_id"), F.col("o_custkey").alias("document_id"))
    return li.join(o, "passage_id")


def supplier_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and documents per node. A customer's co-occurring pair is *stated* when the account is in debt."""
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node"), F.col("s_name").alias("key"),
        F.when(F.col("s_acctbal") < 1000, "Person").when(F.col("s_acctbal") < 4000, "Product").when(F.col("s_acctbal") < 7000, "Service").otherwise("Concept").alias("type"),
    )
    m = supplier_mentions(spark, sf)
    e = G.cooccurrence(m)  # every graph query reads the edges several times: they are written once
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") < 2000, "depends_on").otherwise("co_occurs").alias("relation"))
    e = cut_lineage(e.join(c, "document_id").select("src", "dst", "relation", "weight", "document_id"))
    docs = e.select(F.explode(F.array("src", "dst")).alias("node"), "document_id", (F.col("relation") != "co_occurs").alias("stated"))
    docs = docs.groupBy("node", "document_id").agg(F.bool_or("stated").alias("stated"))
    return s, e.drop("document_id"), docs


_COOC = """
m AS (SELECT DISTINCT o_custkey AS document_id, l_orderkey AS passage_id, l_suppkey AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
co AS (SELECT a.document_id, a.node AS src, b.node AS dst, count(*) AS n FROM m a JOIN m b ON a.passage_id = b.passage_id AND a.node < b.node GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT src, dst, CASE WHEN c_acctbal < 2000 THEN 'depends_on' ELSE 'co_occurs' END AS relation, least(1e0, n / 5e0) AS weight, document_id FROM co JOIN customer ON c_custkey = document_id),
nd AS (SELECT s_suppkey AS node, s_name AS key, CASE WHEN s_acctbal < 1000 THEN 'Person' WHEN s_acctbal < 4000 THEN 'Product' WHEN s_acctbal < 7000 THEN 'Service' ELSE 'Concept' END AS type FROM supplier),
docs AS (SELECT DISTINCT unnest([src, dst]) AS node, document_id FROM e),
adj AS (SELECT DISTINCT unnest([src, dst]) AS node, unnest([dst, src]) AS nb FROM e WHERE src <> dst),
deg AS (SELECT node, count(*) AS deg FROM adj GROUP BY 1),
stated AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE relation <> 'co_occurs')"""
_AA = _COOC + """,
wedge AS (SELECT x.nb AS a, y.nb AS b, x.node AS mid FROM adj x JOIN adj y ON x.node = y.node AND x.nb < y.nb),
aa AS (SELECT a, b, sum(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 0 END) AS aa, count(*) AS shared FROM wedge JOIN deg ON deg.node = mid GROUP BY ALL)"""


@query("cooccurrence", "G9", f"WITH {_COOC} SELECT document_id, src, dst, n::BIGINT AS n, least(1e0, n / 5e0) AS weight FROM co")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return G.cooccurrence(supplier_mentions(spark, sf))


@query("adjacency_degree", "G11 G12", f"""
WITH {_COOC}, dd AS (SELECT node, count(*) AS d FROM (SELECT unnest([src, dst]) AS node FROM e) GROUP BY 1), s AS (SELECT node, count(*) AS st FROM (SELECT unnest([a, b]) AS node FROM stated) GROUP BY 1)
SELECT nd.node, coalesce(deg.deg, 0)::BIGINT AS neighbours, coalesce(dd.d, 0)::BIGINT AS edge_ends, coalesce(s.st, 0)::BIGINT AS stated FROM nd LEFT JOIN deg USING (node) LEFT JOIN dd USING (node) LEFT JOIN s USING (node)
""")
def adjacency_degree(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    d = G.degree(G.adjacency(e)).withColumnRenamed("deg", "neighbours")
    st = G.stated_pairs(e).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("stated"))
    j = G.node_degree(n, e).join(d, "node", "left").join(st, "node", "left")
    return j.select("node", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.col("deg").alias("edge_ends"), F.coalesce("stated", F.lit(0)).alias("stated"))


@query("adamic_adar", "G14", f"""
WITH {_AA}, p AS (SELECT DISTINCT src AS a, dst AS b FROM e) SELECT p.a, p.b, round(coalesce(aa, 0), 6) AS aa, coalesce(shared, 0)::BIGINT AS shared FROM p LEFT JOIN aa USING (a, b)
""")
def adamic_adar(spark: SparkSession, sf: str) -> DataFrame:
    _, e, _ = supplier_graph(spark, sf)
    return G.adamic_adar(G.pairs_of(e), G.adjacency(e)).select("a", "b", F.round("aa", 6).alias("aa"), "shared")


@query("relevance_edges", "G15 G13", f"""
WITH {_AA}, cand AS (SELECT a, b FROM stated UNION SELECT a, b FROM aa UNION SELECT x.node, y.node FROM docs x JOIN docs y ON x.document_id = y.document_id AND x.node < y.node),
nn AS (SELECT node, count(*) AS n FROM docs GROUP BY 1), ii AS (SELECT x.node AS a, y.node AS b, count(*) AS i FROM docs x JOIN docs y ON x.document_id = y.document_id AND x.node < y.node GROUP BY ALL),
s AS (SELECT c.a, c.b, CASE WHEN st.a IS NOT NULL THEN 1e0 ELSE 0e0 END AS direct, CASE WHEN coalesce(n1.n, 0) + coalesce(n2.n, 0) > 0 THEN coalesce(i, 0) / (coalesce(n1.n, 0) + coalesce(n2.n, 0) - coalesce(i, 0))::DOUBLE ELSE 0e0 END AS j, coalesce(aa.aa, 0e0) AS aa,
  CASE WHEN t1.type = 'Person' OR t2.type = 'Person' THEN 15e-2 WHEN (t1.type = 'Product' AND t2.type = 'Service') OR (t2.type = 'Product' AND t1.type = 'Service') THEN 1e0 WHEN t1.type = 'Concept' AND t2.type = 'Concept' THEN 5e-1 ELSE 4e-1 END AS aff
 FROM cand c LEFT JOIN stated st ON st.a = c.a AND st.b = c.b LEFT JOIN aa ON aa.a = c.a AND aa.b = c.b LEFT JOIN ii ON ii.a = c.a AND ii.b = c.b
 LEFT JOIN nn n1 ON n1.node = c.a LEFT JOIN nn n2 ON n2.node = c.b LEFT JOIN nd t1 ON t1.node = c.a LEFT JOIN nd t2 ON t2.node = c.b)
SELECT a, b, round(4e-1 * direct + 25e-2 * j + 2e-1 * (aa / (aa + 1)) + 15e-2 * aff, 6) AS weight, direct, round(j, 6) AS source_overlap, round(aa, 6) AS adamic_adar, aff AS type_affinity
FROM s ORDER BY weight DESC, a, b LIMIT 64
""")
def relevance_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, e, d = supplier_graph(spark, sf)
    return G.relevance_edges(n, e, d)


@query("components", "G16", f"""
WITH RECURSIVE {_COOC}, r(node, comp) AS (SELECT node, node FROM nd UNION SELECT adj.nb, r.comp FROM r JOIN adj ON adj.node = r.node WHERE r.comp < adj.nb)
SELECT node, min(comp) AS comp FROM r GROUP BY node
""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return G.connected_components(n, e)


def _lpa(i: int) -> str:
    return f"""v{i} AS (SELECT node, community, count(*) AS n FROM (SELECT adj.node, l{i - 1}.community FROM adj JOIN l{i - 1} ON l{i - 1}.node = adj.nb UNION ALL SELECT node, community FROM l{i - 1}) GROUP BY ALL),
l{i} AS (SELECT node, min(community) AS community FROM v{i} WHERE n = (SELECT max(n) FROM v{i} w WHERE w.node = v{i}.node) GROUP BY node)"""


_LPA = _COOC + ", l0 AS (SELECT node, node AS community FROM nd), " + ", ".join(_lpa(i) for i in (1, 2, 3)) + ", g AS (SELECT * FROM l3)"
_COH = _LPA + """, sz AS (SELECT community, count(*) AS size FROM g GROUP BY 1), pr AS (SELECT DISTINCT src AS a, dst AS b FROM e),
inn AS (SELECT x.community, count(*) AS internal FROM pr JOIN g x ON x.node = pr.a JOIN g y ON y.node = pr.b AND y.community = x.community GROUP BY 1),
coh AS (SELECT community, size::BIGINT AS size, CASE WHEN size > 1 THEN coalesce(internal, 0) / (size * (size - 1) / 2e0) ELSE 0e0 END AS c FROM sz LEFT JOIN inn USING (community))"""


@query("communities", "G17", f"WITH {_LPA} SELECT node, community FROM g")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return G.communities(n, e)


@query("cohesion", "G17 G20", f"""
WITH {_COH}, lb AS (SELECT community, array_to_string(list(key ORDER BY node)[1:8], ',') AS labels FROM g JOIN nd USING (node) GROUP BY 1)
SELECT community, size, round(c, 6) AS cohesion, CASE WHEN c < 15e-2 AND size >= 3 THEN 'low-cohesion' END AS flag, labels FROM coh JOIN lb USING (community)
""")
def cohesion(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return G.community_summary(G.communities(n, e), n, e)


@query("community_modularity", "G17", f"""
WITH {_COH}, vol AS (SELECT community, count(*) AS volume FROM adj JOIN g USING (node) GROUP BY 1), tot AS (SELECT count(*)::DOUBLE AS m2 FROM adj)
SELECT community, size, coalesce(internal, 0)::BIGINT AS internal, coalesce(volume, 0)::BIGINT AS volume,
  round(2 * coalesce(internal, 0) / m2 - (coalesce(volume, 0) / m2) * (coalesce(volume, 0) / m2), 9) AS modularity
FROM coh LEFT JOIN inn USING (community) LEFT JOIN vol USING (community), tot
""")
def community_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """What each community of label propagation adds to modularity."""
    n, e, _ = supplier_graph(spark, sf)
    return M.modularity(G.communities(n, e), e).withColumn("modularity", F.round("modularity", 9))


@query("modularity_communities", "G17")
def modularity_communities(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return M.modularity_communities(n, e)


@query("surprising", "G18", f"""
WITH {_LPA.replace(_COOC, _AA)} SELECT a, b, round(aa, 6) AS adamic_adar, shared::BIGINT AS shared, x.community AS ca, y.community AS cb FROM aa JOIN g x ON x.node = a JOIN g y ON y.node = b
WHERE x.community <> y.community AND aa > 0 AND NOT EXISTS (SELECT 1 FROM stated s WHERE s.a = aa.a AND s.b = aa.b) ORDER BY round(aa, 6) DESC, a, b LIMIT 10
""")
def surprising(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return G.surprising(G.communities(n, e), e)


@query("knowledge_gaps", "G19", f"""
WITH {_COH}, sdoc AS (SELECT DISTINCT unnest([src, dst]) AS node, document_id FROM e WHERE relation <> 'co_occurs'), cd AS (SELECT community, count(DISTINCT document_id) AS docs FROM g JOIN sdoc USING (node) GROUP BY 1), ndoc AS (SELECT node, count(*) AS documents FROM sdoc GROUP BY 1)
SELECT 'thin-community' AS kind, community::VARCHAR AS label, size AS measure, coalesce(docs, 0)::BIGINT AS documents FROM coh LEFT JOIN cd USING (community) WHERE size >= 3 AND coalesce(docs, 0) <= 1
UNION ALL SELECT 'single-source-concept', key, deg::BIGINT, documents::BIGINT FROM nd JOIN deg USING (node) JOIN ndoc USING (node) WHERE deg >= 3 AND documents = 1
""")
def knowledge_gaps(spark: SparkSession, sf: str) -> DataFrame:
    n, e, d = supplier_graph(spark, sf)
    return G.knowledge_gaps(G.communities(n, e), n, e, d.where("stated").select("node", "document_id"))


@query("top_concepts", "G24 G22", f"""
WITH {_COOC}, dd AS (SELECT node, count(*) AS d FROM (SELECT unnest([src, dst]) AS node FROM e) GROUP BY 1) SELECT nd.node, coalesce(d, 0)::BIGINT AS deg FROM nd LEFT JOIN dd USING (node) ORDER BY coalesce(d, 0) DESC, nd.node DESC LIMIT 40
""")
def top_concepts(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return G.top_concepts(n, e)


@query("neighbours", "J15 G28", f"""
WITH RECURSIVE {_COOC}, st AS (SELECT node FROM nd WHERE type = 'Person'), h1 AS (SELECT DISTINCT nb AS node FROM adj JOIN st USING (node) WHERE nb NOT IN (SELECT node FROM st)),
h2 AS (SELECT DISTINCT nb AS node FROM adj JOIN h1 USING (node) WHERE nb NOT IN (SELECT node FROM st) AND nb NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hop FROM st UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2
""")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    return G.neighbours(n.where("type = 'Person'"), e, 2)


@query("lit_payload", "G23 G21", f"""
WITH {_COOC}, act AS (SELECT node FROM nd WHERE type = 'Person'), halo AS (SELECT DISTINCT nb AS node FROM adj JOIN act USING (node) WHERE nb NOT IN (SELECT node FROM act))
SELECT node, CASE WHEN node IN (SELECT node FROM act) THEN 'activated' WHEN node IN (SELECT node FROM halo) THEN 'halo' ELSE 'dark' END AS state,
 CASE WHEN node IN (SELECT node FROM act) THEN 'Person' WHEN type IN ('Product','Service') THEN type ELSE 'Concept' END AS bucket FROM nd
""")
def lit_payload(spark: SparkSession, sf: str) -> DataFrame:
    n, e, _ = supplier_graph(spark, sf)
    raw = F.when(F.col("type") == "Person", "Team owner").when(F.col("type") == "Service", "rest endpoint").when(F.col("type") == "Product", "release train").otherwise(F.col("type"))
    out = G.lit_payload(n, e, n.where("type = 'Person'"))
    return out.select("node", "state", G.node_type(raw, F.array(F.lit("x"))).alias("bucket"))


@query("concept_documents", "J11 G25", f"""
WITH k AS (SELECT DISTINCT lower(p_type) AS key FROM part UNION SELECT DISTINCT lower(regexp_extract(p_name, '\\S+$')) FROM part)
SELECT key, count(*)::BIGINT AS documents, min(doc_id)::BIGINT AS first_document FROM k JOIN documents ON contains(lower(text), key) WHERE length(key) >= 4 GROUP BY key
""")
def concept_documents(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = p.select(F.lower("p_type").alias("key")).union(p.select(F.lower(F.regexp_extract("p_name", r"\S+$", 0)).alias("key"))).distinct().where(F.length("key") >= 4)
    low = documents(spark, sf).select("doc_id", F.lower("text").alias("low"))
    return lexicon_join(k, "key", low, "low").groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_document"))


def change_documents(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    did = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    uri = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("github://acme/shop/pulls/"), did)).when(F.col("l_returnflag") == "N", F.concat(F.lit("github://acme/shop/commits/"), did)).otherwise(F.concat(F.lit("confluence://OPS/"), did))
    key = lambda x: F.concat(F.lit("ORD-"), x.cast("string"))
    return li.select(did.alias("document_id"), uri.alias("uri"), F.concat(F.lit("Ship "), key(F.col("l_orderkey"))).alias("title"), F.concat(F.lit("Follows "), key(F.col("l_orderkey") + 7), F.lit(" and again "), key(F.col("l_orderkey")), F.lit(".")).alias("text"))


_CHG = """
d0 AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS did, l_returnflag AS f, l_orderkey AS k FROM lineitem),
x AS (SELECT did, CASE f WHEN 'A' THEN 'pull_request' WHEN 'N' THEN 'commit' ELSE 'page' END AS subject_kind,
  CASE f WHEN 'A' THEN 'acme/shop#' || did WHEN 'N' THEN 'acme/shop@' || substr(did, 1, 12) ELSE 'OPS/' || did END AS subject_id, unnest(['ORD-' || k, 'ORD-' || (k + 7)]) AS object_id FROM d0),
ed AS (SELECT DISTINCT subject_kind, subject_id, object_id FROM x WHERE object_id IN (SELECT 'ORD-' || o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW'))"""


@query("cross_source_edges", "G27 G26 J9", f"WITH {_CHG} SELECT sha1(subject_kind || '|' || subject_id || '|mentions|issue|' || object_id) AS edge_id, subject_kind, subject_id, object_id FROM ed")
def cross_source_edges(spark: SparkSession, sf: str) -> DataFrame:
    return issue_edges(spark, sf).drop("document_id")


def issue_edges(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("key"))
    return G.mention_edges(change_documents(spark, sf), known)


@query("cross_source_verdict", "G29 P10", f"""
WITH {_CHG}, r AS (SELECT object_id AS key, count(*) AS refs FROM ed WHERE subject_kind <> 'page' GROUP BY 1),
i AS (SELECT 'ORD-' || o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' ELSE 'In Progress' END AS status FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT coalesce(i.key, r.key) AS key, status, coalesce(refs, 0)::BIGINT AS refs, CASE WHEN status IS NULL THEN 'insufficient' WHEN status = 'Done' AND refs IS NULL THEN 'discrepancy' WHEN status <> 'Done' AND refs > 0 THEN 'partial' ELSE 'agree' END AS verdict
FROM i FULL JOIN r ON i.key = r.key
""")
def cross_source_verdict(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'")
    st = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Open").otherwise("In Progress")
    issues = o.select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("key"), st.alias("status"))
    known = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("key"))
    pairs = G.mention_pairs(change_documents(spark, sf), known, ("commit", "pull_request"))
    return G.cross_source_verdict(issues, pairs.select("subject_kind", "subject_id", "key").distinct())


@query("graph_expand", "R14", f"""
WITH {_COOC}, cand AS (SELECT o_custkey AS query_id, o_orderkey AS passage_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 4),
ms AS (SELECT DISTINCT l_orderkey AS passage_id, l_suppkey AS node FROM lineitem), st AS (SELECT DISTINCT query_id, node FROM cand JOIN ms USING (passage_id) WHERE pos <= 3),
ks AS (SELECT query_id, unnest([st.node, nb]) AS node FROM st JOIN (SELECT unnest([src, dst]) AS node, unnest([dst, src]) AS nb FROM e WHERE relation <> 'co_occurs') USING (node)),
h AS (SELECT DISTINCT query_id, passage_id FROM ks JOIN ms USING (node) JOIN orders ON o_orderkey = passage_id AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT query_id, count(*)::BIGINT AS added, sum(passage_id)::BIGINT AS ids FROM h WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = h.query_id AND c.passage_id = h.passage_id) GROUP BY 1
""")
def graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.fusion import graph_expand as expand
    from ..operators.skew import top_k

    n, e, _ = supplier_graph(spark, sf)
    o = table(spark, sf, "orders")
    cand = top_k(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("passage_id"), "o_totalprice"), ["query_id"], [F.desc("o_totalprice"), F.col("passage_id")], 4, "pos")
    m = supplier_mentions(spark, sf).select("passage_id", F.col("node").alias("node_id")).distinct()
    seen = o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("passage_id"))
    out = expand(cand, m, e.where("relation <> 'co_occurs'"), n.select(F.col("node").alias("node_id"), "key"), seen)
    return out.groupBy("query_id").agg(F.count(F.lit(1)).alias("added"), F.sum("passage_id").alias("ids"))
