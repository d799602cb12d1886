"""Concept graph: co-occurrence, structure, relevance, communities, cross-source edges.

Edges: (src, dst, relation[, weight, contextual_weight]). Hub nodes are the danger here. Pairs of a
hub's neighbours are never written out as such: known pairs are scored by walking the shorter
neighbour list, and pair discovery uses the degree-bounded and overlap-filtered forms below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import pair_blocks, shuffled, top_k

# Relevance weights and read-out thresholds.
WEIGHTS = {"direct": 0.40, "source_overlap": 0.25, "adamic_adar": 0.20, "type_affinity": 0.15}
LOW_COHESION, MIN_FLAG_SIZE, THIN_DOCS, HIGH_DEGREE = 0.15, 3, 1, 3


def cooccurrence(mentions: DataFrame, min_passages: int = 2) -> DataFrame:
    """Entity pairs sharing at least ``min_passages`` passages of one document, weight min(1, n/5).

    ``mentions``: (document_id, passage_id, node), distinct. Only nodes mentioned in that many
    passages of the document can qualify, so the others leave before any pair is formed; the
    pairs of a crowded passage are formed in hash blocks.
    """
    per = mentions.groupBy("document_id", "node").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= min_passages)
    m = mentions.join(per.select("document_id", "node"), ["document_id", "node"], "left_semi")
    p = pair_blocks(m, ["document_id", "passage_id"], "node")
    out = p.groupBy("document_id", F.col("node_a").alias("src"), F.col("node_b").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_passages).withColumn("weight", F.least(F.lit(1.0), F.col("n") / 5.0))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (node, nb) in both directions, self loops dropped."""
    e = edges.where("src is not null and dst is not null and src <> dst")
    return e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nb")))).alias("x")).select("x.node", "x.nb").distinct()


def pairs_of(edges: DataFrame) -> DataFrame:
    e = edges.where("src is not null and dst is not null and src <> dst")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def stated_pairs(edges: DataFrame) -> DataFrame:
    return pairs_of(edges.where("relation <> 'co_occurs'"))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))


def type_affinity(a: Column, b: Column) -> Column:
    person = (a == "Person") | (b == "Person")
    ps = ((a == "Product") & (b == "Service")) | ((a == "Service") & (b == "Product"))
    return F.when(person, 0.15).when(ps, 1.0).when((a == "Concept") & (b == "Concept"), 0.5).otherwise(0.4)


def adamic_adar(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """Adamic-Adar and shared-neighbour count of given (a, b) pairs.

    The neighbours of the endpoint with the smaller degree are listed and looked up at the other
    end, so a hub's list is only ever probed.
    """
    deg = degree(adj)
    da = deg.select(F.col("node").alias("a"), F.col("deg").alias("_da"))
    db = deg.select(F.col("node").alias("b"), F.col("deg").alias("_db"))
    p = pairs.select("a", "b").join(da, "a", "left").join(db, "b", "left").fillna(0, ["_da", "_db"])
    small = F.when(F.col("_da") <= F.col("_db"), F.col("a")).otherwise(F.col("b"))
    p = p.select("a", "b", small.alias("node"), F.when(small == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("_other"))
    w = p.join(adj, "node").select("a", "b", F.col("nb").alias("_mid"), F.col("_other"))
    hit = w.join(adj.select(F.col("node").alias("_other"), F.col("nb").alias("_mid")), ["_other", "_mid"], "left_semi")
    s = hit.join(deg.select(F.col("node").alias("_mid"), "deg"), "_mid").groupBy("a", "b").agg(
        F.sum(F.when(F.col("deg") > 1, 1.0 / F.log(F.col("deg").cast("double"))).otherwise(0.0)).alias("aa"), F.count(F.lit(1)).alias("shared")
    )
    out = pairs.join(s, ["a", "b"], "left")
    return out.withColumn("aa", F.coalesce("aa", F.lit(0.0))).withColumn("shared", F.coalesce("shared", F.lit(0)))


def overlap_pairs(sets: DataFrame, item: str, feature: str, needed: Column) -> DataFrame:
    """Candidate item pairs that may share at least ``needed`` features, by prefix filtering.

    ``needed`` is a column over ``size`` (the item's feature count) giving the least overlap a pair
    with that item must have. Features are ranked rarest first; two items with enough overlap must
    meet within their first size - needed + 1 features. The crowded features come last and are
    left out of the prefixes. Superset of the qualifying pairs; verify afterwards.
    """
    freq = sets.groupBy(feature).agg(F.count(F.lit(1)).alias("_f"))
    size = sets.groupBy(item).agg(F.count(F.lit(1)).alias("size"))
    r = sets.join(freq, feature).join(size, item).withColumn("_need", F.greatest(F.lit(1), needed.cast("long")))
    r = r.where(F.col("_need") <= F.col("size"))
    w = Window.partitionBy(item).orderBy("_f", feature)
    pre = r.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("size") - F.col("_need") + 1)
    p = pair_blocks(pre.select(feature, item), [feature], item)
    return p.select(F.col(f"{item}_a").alias("a"), F.col(f"{item}_b").alias("b")).distinct()


def _jaccard(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Document Jaccard of (a, b) pairs; ``docs``: distinct (node, document_id)."""
    n = docs.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    p = pairs.join(n.select(F.col("node").alias("a"), F.col("_n").alias("na")), "a", "left").join(n.select(F.col("node").alias("b"), F.col("_n").alias("nb")), "b", "left").fillna(0, ["na", "nb"])
    small = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    x = p.select("a", "b", small.alias("node"), F.when(small == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("_o")).join(docs, "node")
    hit = x.join(docs.select(F.col("node").alias("_o"), "document_id"), ["_o", "document_id"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_i"))
    j = p.join(hit, ["a", "b"], "left").withColumn("_i", F.coalesce("_i", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("_i")
    return j.withColumn("source_overlap", F.when(union > 0, F.col("_i") / union).otherwise(0.0)).drop("na", "nb", "_i")


def score_relevance(pairs: DataFrame, nodes: DataFrame, adj: DataFrame, stated: DataFrame, docs: DataFrame) -> DataFrame:
    t = nodes.select("node", "type")
    p = adamic_adar(_jaccard(pairs.select("a", "b"), docs), adj)
    p = p.join(stated.withColumn("_d", F.lit(1.0)), ["a", "b"], "left").withColumn("direct", F.coalesce("_d", F.lit(0.0)))
    p = p.join(t.select(F.col("node").alias("a"), F.col("type").alias("_ta")), "a", "left").join(t.select(F.col("node").alias("b"), F.col("type").alias("_tb")), "b", "left")
    aff = type_affinity(F.coalesce("_ta", F.lit("")), F.coalesce("_tb", F.lit("")))
    p = p.withColumn("affinity", aff)
    weight = (
        WEIGHTS["direct"] * F.col("direct") + WEIGHTS["source_overlap"] * F.col("source_overlap")
        + WEIGHTS["adamic_adar"] * (F.col("aa") / (F.col("aa") + 1.0)) + WEIGHTS["type_affinity"] * F.col("affinity")
    )
    return p.select(
        "a", "b", F.round(weight, 6).alias("weight"), "direct", F.round("source_overlap", 6).alias("source_overlap"),
        F.round("aa", 6).alias("adamic_adar"), F.col("affinity").alias("type_affinity"),
    )


def relevance_edges(nodes: DataFrame, edges: DataFrame, docs: DataFrame, limit: int = 64) -> DataFrame:
    """Top pairs by the four-signal blend over all pairs sharing an edge, a document or a neighbour.

    Stated pairs are scored first; the limit-th of them is a floor for the list. A pair without a
    stated edge weighs less than 0.35 + 0.25 J, so other pairs only matter with document Jaccard
    J >= (floor - 0.35) / 0.25, which overlap_pairs finds without pairing crowded documents. Only
    when the floor is below 0.35 can a pair sharing nothing but a neighbour or few documents enter,
    and then all of them are formed, in blocks.
    """
    adj = cut_lineage(adjacency(edges))
    stated = cut_lineage(stated_pairs(edges))
    docs = cut_lineage(docs.select("node", "document_id").distinct())
    first = cut_lineage(score_relevance(stated, nodes, adj, stated, docs))
    top = first.orderBy(F.desc("weight"), "a", "b").limit(limit)
    got = top.agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("m")).first()
    floor = got["m"] if got["n"] >= limit else 0.0
    rest = WEIGHTS["adamic_adar"] + WEIGHTS["type_affinity"]
    need = (floor - 1e-6 - rest) / WEIGHTS["source_overlap"]
    if need > 0:
        # J >= need implies overlap >= need * size of either side
        more = overlap_pairs(docs, "node", "document_id", F.ceil(F.lit(need) * F.col("size") - 1e-9))
    else:
        shared_doc = pair_blocks(docs, ["document_id"], "node").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        shared_nb = pair_blocks(adj, ["node"], "nb").select(F.col("nb_a").alias("a"), F.col("nb_b").alias("b"))
        more = shared_doc.unionByName(shared_nb).distinct()
    more = more.join(stated, ["a", "b"], "left_anti")
    out = first.unionByName(score_relevance(more, nodes, adj, stated, docs))
    return out.orderBy(F.desc("weight"), "a", "b").limit(limit)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node id per node, by minimum labels with pointer jumping.

    Every round takes the least label among the neighbours (an aggregate with map-side combine, so
    a hub is no hot spot) and then the label of that label, which halves path lengths. Labels only ever
    fall, so the rounds end, and they end when nothing moves.
    """
    adj = cut_lineage(adjacency(edges))
    lab = nodes.select("node").distinct().withColumn("comp", F.col("node"))
    lab = cut_lineage(lab)
    while True:
        near = adj.join(lab.select(F.col("node").alias("nb"), "comp"), "nb").groupBy("node").agg(F.min("comp").alias("m"))
        step = lab.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("n1"))
        jump = lab.select(F.col("node").alias("n1"), F.col("comp").alias("c2"))
        new = step.join(jump, "n1", "left").select("node", F.least("n1", F.coalesce("c2", "n1")).alias("new"), "comp")
        new = cut_lineage(new)
        moved = new.where("new <> comp").limit(1).count()
        lab = new.select("node", F.col("new").alias("comp"))
        if not moved:
            return lab


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Communities by synchronous label propagation with a fixed number of rounds.

    A node takes the most frequent label among its neighbours and itself, ties to the smallest.
    Votes are counts per (node, label), so a hub's neighbours are combined before they move.
    """
    adj = cut_lineage(adjacency(edges))
    lab = nodes.select("node", F.col("node").alias("community")).distinct()
    for _ in range(rounds):
        votes = adj.join(lab.select(F.col("node").alias("nb"), "community"), "nb").select("node", "community").unionByName(lab)
        n = votes.groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy("node").agg(F.max("n").alias("n"))
        lab = n.join(top, ["node", "n"]).groupBy("node").agg(F.min("community").alias("community"))
        lab = cut_lineage(lab)
    return lab


def cohesion(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal over possible edges per community, flagged when low."""
    size = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    p = pairs_of(edges)
    j = p.join(groups.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(groups.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inner = j.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    out = size.join(inner, "community", "left")
    possible = F.col("size") * (F.col("size") - 1) / 2
    c = F.when(possible > 0, F.coalesce("internal", F.lit(0)) / possible).otherwise(0.0)
    return out.select("community", "size", F.round(c, 6).alias("cohesion"), F.when((c < LOW_COHESION) & (F.col("size") >= MIN_FLAG_SIZE), "low-cohesion").alias("flag"))


def community_summary(groups: DataFrame, nodes: DataFrame, edges: DataFrame, labels: int = 8) -> DataFrame:
    """Size, cohesion, flag and the first labels of each community."""
    named = groups.join(nodes.select("node", "key"), "node", "left")
    w = Window.partitionBy("community").orderBy("node")
    first = named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= labels)
    lab = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.coalesce("key", F.col("node").cast("string")).alias("k")))), lambda x: x["k"]), ",").alias("labels"))
    return cohesion(groups, edges).join(lab, "community")


def surprising(groups: DataFrame, edges: DataFrame, limit: int = 10, light: int = 1000) -> DataFrame:
    """Unstated pairs of different communities by Adamic-Adar.

    Connectors of degree up to ``light`` pair their neighbours in blocks; that gives candidates
    whose full score includes every connector. A pair that only shares heavier connectors scores at
    most h / ln(light + 1) for h shared ones, so it matters only with h >= floor * ln(light + 1),
    where ``floor`` is the list's last score; those pairs come from overlap_pairs over the heavy
    connectors alone. Nothing is dropped.
    """
    adj = cut_lineage(adjacency(edges))
    deg = degree(adj)
    stated = stated_pairs(edges)
    ca = groups.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    cb = groups.select(F.col("node").alias("b"), F.col("community").alias("cb"))

    def eligible(p: DataFrame) -> DataFrame:
        p = p.join(ca, "a").join(cb, "b").where("ca <> cb").join(stated, ["a", "b"], "left_anti")
        return adamic_adar(p, adj).where("aa > 0").select("a", "b", F.round("aa", 6).alias("adamic_adar"), "shared", "ca", "cb")

    small = adj.join(deg.where(F.col("deg") <= light).select("node"), "node", "left_semi")
    p = pair_blocks(small, ["node"], "nb").select(F.col("nb_a").alias("a"), F.col("nb_b").alias("b")).distinct()
    scored = eligible(p)
    heavy = adj.join(deg.where(F.col("deg") > light).select("node"), "node", "left_semi")
    if heavy.limit(1).count():
        got = scored.orderBy(F.desc("adamic_adar"), "a", "b").limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min("adamic_adar").alias("m")).first()
        floor = got["m"] if got["n"] >= limit else 0.0
        need = max(1, math.ceil((floor - 1e-6) * math.log(light + 1)))
        more = overlap_pairs(heavy.select(F.col("nb").alias("item"), F.col("node").alias("hub")), "item", "hub", F.lit(need))
        scored = scored.unionByName(eligible(more.join(p, ["a", "b"], "left_anti")))
    return scored.orderBy(F.desc("adamic_adar"), "a", "b").limit(limit)


def knowledge_gaps(groups: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Communities of three or more nodes on at most one document; nodes of degree >= 3 on one document."""
    d = docs.select("node", "document_id").distinct()
    size = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    cd = groups.join(d, "node").groupBy("community").agg(F.count_distinct("document_id").alias("docs"))
    thin = size.join(cd, "community", "left").where((F.col("size") >= MIN_FLAG_SIZE) & (F.coalesce("docs", F.lit(0)) <= THIN_DOCS))
    thin = thin.select(F.lit("thin-community").alias("kind"), F.col("community").cast("string").alias("label"), F.col("size").alias("measure"), F.coalesce("docs", F.lit(0)).alias("documents"))
    nd = d.groupBy("node").agg(F.count(F.lit(1)).alias("documents"))
    single = nodes.select("node", "key").join(degree(adjacency(edges)), "node").join(nd, "node").where((F.col("deg") >= HIGH_DEGREE) & (F.col("documents") == 1))
    return thin.unionByName(single.select(F.lit("single-source-concept").alias("kind"), F.col("key").cast("string").alias("label"), F.col("deg").alias("measure"), "documents"))


# Type buckets and hints.
BUCKETS = ("Concept", "Product", "Service", "Repository", "Person")
TYPE_HINTS = [
    ("Repository", ("repository", "repo", "codebase", "package")),
    ("Person", ("person", "author", "contributor", "team", "owner", "user")),
    ("Service", ("service", "api", "endpoint", "connector", "system")),
    ("Product", ("product", "release", "component", "platform", "module", "feature")),
]


def node_type(raw: Column, labels: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    hay = F.lower(F.concat_ws(" ", t, F.array_join(labels, " ")))
    out = F.when(t.isin(*BUCKETS), t)
    for bucket, hints in TYPE_HINTS:
        for h in hints:
            out = out.when(hay.contains(h), bucket)
    return out.otherwise("Concept")


def edge_weight(weight: Column, contextual: Column) -> Column:
    return F.coalesce(F.nullif(weight, F.lit(0.0)), F.nullif(contextual, F.lit(0.0)), F.lit(1.0))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends per node, counting only edges inside the node set."""
    n = nodes.select("node")
    e = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    d = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    return n.join(d, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"))


def top_concepts(nodes: DataFrame, edges: DataFrame, n: int = 40) -> DataFrame:
    return node_degree(nodes, edges).orderBy(F.desc("deg"), F.desc("node")).limit(n)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if("conflict").alias("contradictions"))
    return n.join(e, F.lit(True))


def neighbours(start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` of the start nodes, with their distance: frontier joins, seen nodes removed."""
    adj = adjacency(edges)
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        nxt = frontier.join(adj, "node").select(F.col("nb").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h))
        nxt = cut_lineage(nxt)
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def lit_payload(nodes: DataFrame, edges: DataFrame, activated: DataFrame) -> DataFrame:
    """Nodes with their state for one trace: activated, one-hop halo, or dark."""
    act = activated.select("node").distinct()
    adj = adjacency(edges)
    halo = adj.join(act, "node", "left_semi").select(F.col("nb").alias("node")).distinct().join(act, "node", "left_anti")
    j = nodes.join(act.withColumn("_a", F.lit(True)), "node", "left").join(halo.withColumn("_h", F.lit(True)), "node", "left")
    return j.withColumn("state", F.when(F.col("_a"), "activated").when(F.col("_h"), "halo").otherwise("dark")).drop("_a", "_h")


# ---- cross-source relationships -----------------------------------------------------------
# Issue keys, entity uris, done-like states, verification wording.
ISSUE_KEY = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
JIRA_URI = r"^jira://[^/]+/([A-Z][A-Z0-9]{1,9}-\d+)$"
CODE_URI = r"^github://([^/]+/[^/]+)/(pulls|commits|issues)/(.+)$"
PAGE_URI = r"^confluence://([^/]+)/([^/]+)$"
DONE_LIKE = "done closed resolved released complete completed shipped merged deployed".split()


def uri_entity(uri: Column, doc_id: Column) -> tuple[Column, Column]:
    """(kind, id) of a document from its uri."""
    repo, kind, ref = (F.regexp_extract(uri, CODE_URI, i) for i in (1, 2, 3))
    k = F.when(uri.rlike(JIRA_URI), "issue").when(kind == "pulls", "pull_request").when(kind == "commits", "commit").when(
        kind == "issues", "gh_issue").when(uri.rlike(PAGE_URI), "page").otherwise("document")
    i = F.when(uri.rlike(JIRA_URI), F.regexp_extract(uri, JIRA_URI, 1)).when(kind == "pulls", F.concat(repo, F.lit("#"), ref)).when(
        kind == "commits", F.concat(repo, F.lit("@"), F.substring(ref, 1, 12))).when(kind == "issues", F.concat(repo, F.lit("!"), ref)).when(
        uri.rlike(PAGE_URI), F.concat(F.regexp_extract(uri, PAGE_URI, 1), F.lit("/"), F.regexp_extract(uri, PAGE_URI, 2))).otherwise(doc_id.cast("string"))
    return k, i


def mention_pairs(documents: DataFrame, known: DataFrame, kinds: Sequence[str] | None = None, max_chars: int | None = None, pattern: str = ISSUE_KEY) -> DataFrame:
    """(subject_kind, subject_id, key, document_id) of documents that name a known issue key, never their own.

    ``documents``: (document_id, uri, title, text); ``known``: (key). ``kinds`` narrows the documents before
    their texts are searched. The whole text is read unless ``max_chars`` is given.
    """
    if kinds is not None:
        documents = documents.where(uri_entity(F.col("uri"), F.col("document_id"))[0].isin(*kinds))
    kind, sid = uri_entity(F.col("uri"), F.col("document_id"))
    body = F.coalesce("text", F.lit(""))
    body = body if max_chars is None else F.substring(body, 1, max_chars)
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), body)
    d = documents.select(kind.alias("subject_kind"), sid.alias("subject_id"), "document_id", F.explode(F.array_distinct(F.regexp_extract_all(hay, F.lit(pattern), F.lit(1)))).alias("key"))
    return d.where("key <> subject_id").join(known.select("key"), "key", "left_semi")


def mention_edges(documents: DataFrame, known: DataFrame, max_chars: int | None = None, pattern: str = ISSUE_KEY) -> DataFrame:
    """One ``mentions`` edge per subject and known issue key, with the smallest document that states it."""
    e = mention_pairs(documents, known, None, max_chars, pattern).groupBy("subject_kind", "subject_id", F.col("key").alias("object_id")).agg(F.min("document_id").alias("document_id"))
    eid = F.sha1(F.concat_ws("|", "subject_kind", "subject_id", F.lit("mentions"), F.lit("issue"), "object_id"))
    return e.select(eid.alias("edge_id"), "subject_kind", "subject_id", "object_id", "document_id")


def mentions_of(edges: DataFrame, object_id: str, kinds: list[str] | None = None) -> DataFrame:
    out = edges.where(F.col("object_id") == object_id)
    return out if kinds is None else out.where(F.col("subject_kind").isin(*kinds))


def edges_touching(edges: DataFrame, entity_id: str) -> DataFrame:
    return edges.where((F.col("object_id") == entity_id) | (F.col("subject_id") == entity_id))


def cross_source_verdict(issues: DataFrame, references: DataFrame) -> DataFrame:
    """Issue state against code references: agree, discrepancy, partial or insufficient.

    ``issues``: (key, status); ``references``: (key, subject_kind), counted for commits and pull requests.
    """
    r = references.where(F.col("subject_kind").isin("commit", "pull_request")).groupBy("key").agg(F.count(F.lit(1)).alias("refs"))
    j = issues.join(r, "key", "full").withColumn("refs", F.coalesce("refs", F.lit(0)))
    done = F.lower(F.trim("status")).isin(*DONE_LIKE)
    v = F.when(F.col("status").isNull(), "insufficient").when(done & (F.col("refs") == 0), "discrepancy").when(~done & (F.col("refs") > 0), "partial").otherwise("agree")
    return j.select("key", "status", "refs", v.alias("verdict"))


VERIFY_VERB = (
    r"(?i)\b(verif(?:y|ies|ied|ication)|cross[- ]?check|corroborate|reconcile|"
    r"double[- ]?check|confirm(?:ed|s)?|really (?:done|complete)|actually (?:done|complete))\b"
)
CODE_NOUN = r"(?i)\b(repo|repository|code|commit|commits|pull request|prs?|github)\b"


def wants_verification(q: Column) -> Column:
    return q.rlike(VERIFY_VERB) & (q.rlike(ISSUE_KEY) | q.rlike(CODE_NOUN))


# ---- call graph ---------------------------------------------------------------------------
def call_graph(symbols: DataFrame) -> DataFrame:
    """In-repository call edges (src, dst) from (repo, module, qualified, kind, cls, calls, imports).

    Each call is tried under ordered rules: method of the own class, name in the own module, name
    reached through an import, exact qualified name, suffix owned by exactly one symbol. The first
    rule with a target wins; a suffix shared by several symbols gives no edge.
    """
    known = symbols.select("repo", F.col("qualified").alias("target")).distinct()
    parts = F.split("target", r"\.")
    suffix = known.select("repo", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))).alias("name"))
    owned = suffix.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("target").alias("_first"), F.bool_or(F.col("name") == F.col("target")).alias("_full"))
    mod_imp = symbols.where("kind = 'module'").select("repo", "module", F.col("imports").alias("_mi"))
    callers = symbols.where(F.col("kind").isin("class", "function", "method", "cell", "statement")).join(shuffled(mod_imp), ["repo", "module"], "left")
    c = callers.select("repo", F.col("qualified").alias("src"), "module", "cls", F.concat(F.coalesce("_mi", F.array().cast("array<string>")), F.coalesce("imports", F.array().cast("array<string>"))).alias("imps"), F.explode(F.array_distinct("calls")).alias("call"))
    p = F.split("call", r"\.")
    own = F.when(p[0].isin("self", "this", "cls") & F.col("cls").isNotNull() & (F.size(p) >= 2), F.concat_ws(".", "module", "cls", p[1]))
    imp = F.filter("imps", lambda i: F.regexp_replace(i, r"^\.+", "").endswith(F.concat(F.lit("."), p[0])) | (F.regexp_replace(i, r"^\.+", "") == p[0]))
    first_imp = F.try_element_at(F.transform(imp, lambda i: F.regexp_replace(i, r"^\.+", "")), F.lit(1))
    tail = F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), ".")
    c = c.withColumn("own", own).withColumn("local", F.when(F.col("own").isNull(), F.concat_ws(".", "module", "call")))
    c = c.withColumn("via", F.when(F.col("own").isNull() & first_imp.isNotNull(), F.when(tail == "", first_imp).otherwise(F.concat_ws(".", first_imp, tail))))
    # the names a call may mean, first rule first, looked up in one join
    caller = ["repo", "src", "own", "local", "via", "call"]
    tries = F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.lit(i).alias("rule"), F.col(x).alias("name"))) for i, x in enumerate(("own", "local", "via"))], F.when(F.col("own").isNull(), F.struct(F.lit(3).alias("rule"), F.col("call").alias("name")))))
    t = c.select(*caller, F.explode(tries).alias("_t")).select(*caller, "_t.rule", "_t.name").distinct().join(shuffled(owned), ["repo", "name"])
    dst = F.when(F.col("rule") == 2, F.col("_first")).when(F.col("_full"), F.col("name")).when((F.col("rule") == 3) & (F.col("_n") == 1), F.col("_first"))
    found = t.withColumn("dst", dst).where("dst is not null").groupBy(*caller).agg(F.min(F.struct("rule", "dst"))["dst"].alias("dst"))
    return found.where("dst <> src").select("repo", "src", "dst").distinct()


def call_degrees(symbols: DataFrame, edges: DataFrame, n: int = 30) -> DataFrame:
    """Most connected symbols per repository: in + out degree, ties by name."""
    d = edges.select("repo", F.explode(F.array("src", "dst")).alias("qualified")).groupBy("repo", "qualified").agg(F.count(F.lit(1)).alias("degree"))
    ranked = top_k(d, ["repo"], [F.desc("degree"), F.col("qualified")], n)
    return ranked.join(shuffled(symbols.select("repo", "qualified", "path", "symbol_kind").dropDuplicates(["repo", "qualified"])), ["repo", "qualified"])
