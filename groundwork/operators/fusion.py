"""Rank fusion, authority, subject and persona boosts, grounding, level choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, tokens
from .skew import top_k

# Fusion constant, authority decay and boost, default source ranks.
RRF_K = 60
DECAY, AUTHORITATIVE_BOOST, UNKNOWN_RANK = 0.25, 1.5, 5
DEFAULT_RANKS = {
    "files": 1, "confluence": 2, "sharepoint": 2, "github": 3,
    "jira": 4, "drive": 3, "upload": 2, "cli": 2,
}
# Grounding weights and the smallest signal.
GROUNDING = {"retrieval": 1.0, "semantic": 1.2, "coverage": 1.2, "agreement": 0.8, "resolvable": 1.0}
EPS = 1e-6


def rrf(*ranked: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of lists with (query_id, passage_id, rank from 1)."""
    parts = [r.select("query_id", "passage_id", (1.0 / (RRF_K + F.col("rank"))).alias("s")) for r in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "passage_id").agg(F.round(F.sum("s"), 12).alias("fused"))


def authority_weight(rank: Column) -> Column:
    return F.round(1.0 / (1.0 + DECAY * (F.greatest(F.lit(1), rank) - 1)), 6)


def _default_ranks() -> Column:
    return F.create_map(*[x for k, v in DEFAULT_RANKS.items() for x in (F.lit(k), F.lit(v))])


def effective_rank(source: Column, override: Column) -> Column:
    """Tenant override, else the default of the source, else 5."""
    return F.coalesce(override, F.try_element_at(_default_ranks(), source), F.lit(UNKNOWN_RANK)).cast("int")


def source_ranks(spark_defaults: DataFrame, overrides: DataFrame, documents: DataFrame) -> DataFrame:
    """Every known source with its effective rank: defaults, overrides and document sources."""
    names = spark_defaults.select("source").union(overrides.select("source"))
    names = names.union(documents.where(F.col("source") != "").select("source").distinct()).distinct()
    j = names.join(overrides.select("source", F.col("rank").alias("_o")), "source", "left")
    rank = effective_rank(F.col("source"), F.col("_o"))
    return j.select(
        "source", rank.alias("rank"), authority_weight(rank).alias("weight"), F.col("_o").isNotNull().alias("overridden")
    )


def authority_boost(fused: DataFrame, passage_docs: DataFrame, ranks: DataFrame, documents: DataFrame) -> DataFrame:
    """Fused score x source weight x 1.5 for curator-marked documents; ties keep the incoming order.

    ``fused``: (query_id, passage_id, fused, idx). Unknown passages keep their score.
    """
    d = passage_docs.select("passage_id", "document_id", "source")
    j = fused.join(d, "passage_id", "left").join(ranks.select("source", "weight"), "source", "left")
    j = j.join(documents.select("document_id", "authoritative"), "document_id", "left")
    mult = F.coalesce("weight", F.lit(1.0)) * F.when(F.coalesce("authoritative", F.lit(False)), AUTHORITATIVE_BOOST).otherwise(1.0)
    out = j.withColumn("boosted", F.round(F.col("fused") * mult, 8))
    w = Window.partitionBy("query_id").orderBy(F.desc("boosted"), F.col("idx"))
    return out.select("query_id", "passage_id", "document_id", "boosted", F.row_number().over(w).alias("rank"))


def best_cited(citations: DataFrame) -> DataFrame:
    """Most trusted cited source: authoritative first, then best rank, then first cited.

    ``citations``: (answer_id, document_id, source, rank, authoritative, pos).
    """
    key = F.struct((~F.col("authoritative")).alias("a"), "rank", "pos")
    out = citations.groupBy("answer_id").agg(
        F.min_by(F.struct("document_id", "source", "rank", "authoritative"), key).alias("b"),
        F.count(F.lit(1)).alias("cited"),
    )
    return out.select("answer_id", "b.*", "cited")


def authority_conflicts(citations: DataFrame) -> DataFrame:
    """Pairs of cited documents of different sources whose rank or flag differ; ``a`` is cited first."""
    from .skew import pair_blocks

    cols = ["document_id", "source", "rank", "authoritative"]
    p = pair_blocks(citations.select("answer_id", "pos", *cols), ["answer_id"], "pos", cols)
    diff = (F.col("rank_a") != F.col("rank_b")) | (F.col("authoritative_a") != F.col("authoritative_b"))
    p = p.where((F.col("source_a") != F.col("source_b")) & diff)
    key = lambda s: F.struct((~F.col(f"authoritative_{s}")).alias("x"), F.col(f"rank_{s}").alias("y"), F.col(f"pos_{s}").alias("z"))
    pref = F.when(key("a") <= key("b"), F.col("document_id_a")).otherwise(F.col("document_id_b"))
    return p.select("answer_id", F.col("document_id_a").alias("a"), F.col("document_id_b").alias("b"), pref.alias("preferred"))


def distinctive_titles(documents: DataFrame) -> DataFrame:
    """Title tokens owned by exactly one document, from (document_id, title)."""
    t = documents.select("document_id", F.explode(F.array_distinct(tokens("title"))).alias("token"))
    one = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id"))
    return one.where("n = 1").select("token", "document_id")


def question_subjects(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, document_id) named by a distinctive title token of the question."""
    q = questions.select("query_id", F.explode(content_tokens("text")).alias("token"))
    return q.join(titles, "token").select("query_id", "document_id").distinct()


def subject_boost(fused: DataFrame, subjects: DataFrame, passages: DataFrame, inject: int = 3) -> DataFrame:
    """Lift the named document's passages by the list's top score; inject its first passages if absent.

    ``fused``: (query_id, passage_id, document_id, fused). ``passages`` must be the *visible* live
    passages (passage_id, document_id, pos).
    """
    top = fused.groupBy("query_id").agg(F.max("fused").alias("mx"))
    subj = subjects.join(top, "query_id").withColumn("mx", F.when(F.col("mx") == 0, 1.0).otherwise(F.col("mx")))
    j = fused.join(subj.select("query_id", "document_id", F.col("mx").alias("_lift")), ["query_id", "document_id"], "left")
    lifted = j.select("query_id", "passage_id", "document_id", (F.col("fused") + F.coalesce("_lift", F.lit(0.0))).alias("fused"), F.lit(False).alias("injected"))
    absent = subj.join(fused.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti")
    need = passages.join(absent.select("document_id").distinct(), "document_id", "left_semi")
    first = top_k(need, ["document_id"], [F.col("pos"), F.col("passage_id")], inject, "_r")
    added = absent.join(first, "document_id").select("query_id", "passage_id", "document_id", F.col("mx").alias("fused"), F.lit(True).alias("injected"))
    return lifted.unionByName(added)


def ensure_subject(selected: DataFrame, candidates: DataFrame, subjects: DataFrame) -> DataFrame:
    """When no selected passage is of a named document, its best candidate replaces the last pick.

    ``selected``: (query_id, passage_id, document_id, pick); ``candidates``: (.., pos).
    """
    s = subjects.withColumn("_s", F.lit(True))
    sel = selected.join(s, ["query_id", "document_id"], "left")
    w = Window.partitionBy("query_id")
    sel = sel.withColumn("_has", F.bool_or(F.coalesce("_s", F.lit(False))).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    swap = candidates.join(subjects, ["query_id", "document_id"]).groupBy("query_id").agg(
        F.min_by(F.struct("passage_id", "document_id"), F.struct("pos", "passage_id")).alias("c")
    )
    j = sel.join(swap, "query_id", "left")
    replace = ~F.col("_has") & F.col("c").isNotNull()
    kept = j.where(~replace | (F.col("pick") < F.col("_n"))).select(
        "query_id", "passage_id", "document_id", (F.col("pick") + replace.cast("int")).alias("pick")
    )
    new = j.where(replace & (F.col("pick") == 1)).select("query_id", "c.passage_id", "c.document_id", F.lit(1).alias("pick"))
    return kept.unionByName(new)


# Designation words to persona, sentences an answer may carry, emphasis.
PERSONA_DEPTH = {"headline": 1, "brief": 2, "full": 3}


def persona_boost(fused: DataFrame, matches: DataFrame) -> DataFrame:
    """+0.5 x the list's best score for passages matching the reader's emphasis.

    ``matches``: (query_id, passage_id) rows the emphasis selects.
    """
    w = Window.partitionBy("query_id")
    j = fused.join(matches.select("query_id", "passage_id").distinct().withColumn("_m", F.lit(True)), ["query_id", "passage_id"], "left")
    mx = F.max("fused").over(w)
    mx = F.when(mx == 0, 1.0).otherwise(mx)
    return j.withColumn("fused", F.col("fused") + F.when(F.col("_m"), 0.5 * mx).otherwise(0.0)).drop("_m")


def graph_expand(candidates: DataFrame, mentions: DataFrame, edges: DataFrame, nodes: DataFrame, passages: DataFrame, lead: int = 3) -> DataFrame:
    """Passages holding a concept next to the concepts of the first ``lead`` candidates.

    ``mentions``: (passage_id, node_id); ``nodes``: (node_id, key); ``passages`` the visible ones.
    """
    head = candidates.where(F.col("pos") <= lead).select("query_id", "passage_id")
    start = head.join(mentions, "passage_id").select("query_id", "node_id").distinct()
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("nb")).unionByName(
        edges.select(F.col("dst").alias("node_id"), F.col("src").alias("nb"))
    )
    near = start.join(both, "node_id")
    keys = near.select("query_id", F.explode(F.array("node_id", "nb")).alias("node_id")).distinct()
    keys = keys.join(nodes.where(F.length("key") > 3), "node_id", "left_semi")
    hits = keys.join(mentions, "node_id").select("query_id", "passage_id").distinct()
    hits = hits.join(passages.select("passage_id"), "passage_id", "left_semi")
    fresh = hits.join(candidates.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    return fresh.withColumn("graph_hops", F.lit(1))


def grounding(selected: DataFrame) -> DataFrame:
    """Five signals per question and their weighted geometric mean.

    ``selected``: (query_id, passage_id, fused, vscore, qtok array, ptok array, located boolean),
    where ``qtok`` are the distinct content tokens of the question and ``ptok`` the passage's tokens.
    """
    shared = F.array_intersect("qtok", "ptok")
    s = selected.select(
        "query_id", "fused", "vscore", "located", F.size("qtok").alias("nq"), F.size(shared).alias("hit"), shared.alias("shared")
    )
    base = s.groupBy("query_id").agg(
        F.max("fused").alias("mf"), F.max("vscore").alias("mv"), F.max("nq").alias("nq"),
        F.count(F.lit(1)).alias("n"), F.count_if("located").alias("loc"), F.count_if(F.col("hit") > 0).alias("cor"),
    )
    cov = s.select("query_id", F.explode("shared").alias("t")).groupBy("query_id").agg(F.count_distinct("t").alias("covered"))
    b = base.join(cov, "query_id", "left")
    ceiling = 2.0 / (RRF_K + 1)
    b = b.withColumn("retrieval", F.least(F.lit(1.0), F.col("mf") / ceiling))
    b = b.withColumn("semantic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mv"))))
    b = b.withColumn("coverage", F.when(F.col("nq") > 0, F.coalesce("covered", F.lit(0)) / F.col("nq")).otherwise(0.5))
    b = b.withColumn("agreement", F.when(F.col("nq") > 0, F.least(F.lit(1.0), F.col("cor") / F.least(F.lit(3), F.col("n")))).otherwise(F.col("semantic")))
    b = b.withColumn("resolvable", F.col("loc") / F.col("n"))
    num = sum((F.lit(w) * F.log(F.greatest(F.col(k), F.lit(EPS))) for k, w in GROUNDING.items()), F.lit(0.0))
    b = b.withColumn("grounding", F.round(F.exp(num / F.lit(sum(GROUNDING.values()))), 4))
    return b.select("query_id", *[F.round(k, 4).alias(k) for k in GROUNDING], "grounding")


def exact_signal_floor(g: Column, exact: Column, threshold: float) -> Column:
    return F.when((g < threshold) & exact, F.lit(threshold + 0.05)).otherwise(g)


def decision(g: Column, threshold: float) -> Column:
    return F.when(g >= threshold, "answer").when(g >= threshold * 0.5, "clarify").otherwise("gap")


def ambiguous(selected: DataFrame) -> DataFrame:
    """Whether the two best documents among the first four picks are within 15 %."""
    d = selected.where(F.col("pick") <= 4).groupBy("query_id", "document_id").agg(F.min_by("fused", "pick").alias("s"))
    two = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2)
    out = d.groupBy("query_id").agg(two.alias("t"))
    a, b = F.try_element_at("t", F.lit(1)), F.try_element_at("t", F.lit(2))
    return out.select("query_id", F.coalesce((b > 0) & ((a - b) / (a + EPS) < 0.15), F.lit(False)).alias("ambiguous"))


def confidence(g: Column, cites: Column, selected: Column) -> Column:
    return F.round(F.least(F.lit(0.99), g * 0.9 + 0.05 * cites / F.greatest(F.lit(1), selected)), 3)


# Level choice.
LEVEL_STOP = "the a an of to in on for and or is are what which how who when where does do did was".split()
REASONING = "why how compare difference explain analyse analyze evaluate recommend implication trade-off tradeoff versus vs".split()
LOOKUP = "what which who when where list define status".split()
LEVEL_NAMES = {1: ("lookup", "none"), 2: ("fast", "fast"), 3: ("reason", "deep"), 4: ("escalation", "escalation")}
DEFINITION = r"(?i)^\s*(?:what|who)\s+(?:is|are)\s+(.+?)\??$|^\s*define\s+(.+?)\??$"


def level_tokens(question: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in LEVEL_STOP])
    return F.filter(tokens(question), lambda t: ~F.array_contains(stop, t))


def select_level(df: DataFrame) -> DataFrame:
    """Adds level, level_name, tier, reasons and a complexity score.

    Input columns: question, doc_spread (documents in the first five), grounding, graph_used,
    top_title. The rules run in a fixed order, each a column over the level before it.
    """
    low = F.lower("question")
    n = F.size(level_tokens(F.col("question")))
    reasoning = F.lit(False)
    for w in REASONING:
        reasoning = reasoning | low.contains(w)
    first = F.try_element_at(F.filter(F.split(low, r"\s+"), lambda x: x != ""), F.lit(1))
    lookup = F.coalesce(first.isin(*LOOKUP), F.lit(False)) & ~reasoning
    base = F.when(reasoning, 3).when(lookup & (n <= 8), 1).otherwise(2)
    target = F.coalesce(
        F.nullif(F.regexp_extract(F.trim("question"), DEFINITION, 1), F.lit("")), F.regexp_extract(F.trim("question"), DEFINITION, 2)
    )
    title = F.lower(F.coalesce("top_title", F.lit("")))
    hit = F.exists(level_tokens(target), lambda t: title.contains(t))
    locked = ~reasoning & (title != "") & hit
    out = df.withColumn("_n", n).withColumn("_rs", reasoning).withColumn("_base", base).withColumn("_lock", locked)
    l1 = F.when(F.col("_lock"), 1).otherwise(F.col("_base"))
    spread = F.col("doc_spread")
    up = ~F.col("_lock") & (spread >= 2) & (l1 < 2)
    l2 = F.when(up, 2).otherwise(l1)
    graph = F.col("graph_used") & ~F.col("_lock")
    l3 = F.when(graph & (l2 < 2), 2).otherwise(l2)
    longq = (F.col("_n") >= 12) & (l3 < 3) & ~F.col("_lock")
    l4 = F.when(longq, 3).otherwise(l3)
    out = out.withColumn("level", l4.cast("int"))
    why = F.array_compact(F.array(
        F.when(F.col("_base") == 3, "reasoning_intent").when(F.col("_base") == 1, "factual_lookup").otherwise("synthesis"),
        F.when(F.col("_lock"), "definition"),
        F.when(up & (spread >= 3), "multi_document").when(up, "two_document"),
        F.when(graph, "graph_multi_hop"),
        F.when(longq, "long_query"),
        F.when((F.col("level") == 1) & (F.col("grounding") >= 0.7), "high_grounding"),
    ))
    out = out.withColumn("reasons", why)
    return with_level_names(out).withColumn(
        "complexity", F.round(F.least(F.lit(1.0), 0.15 * F.col("level") + 0.03 * F.col("_n") + 0.1 * spread), 3)
    ).drop("_n", "_rs", "_base", "_lock")


def with_level_names(df: DataFrame) -> DataFrame:
    name = tier = None
    for lv, (nm, tr) in LEVEL_NAMES.items():
        name = F.when(F.col("level") == lv, nm) if name is None else name.when(F.col("level") == lv, nm)
        tier = F.when(F.col("level") == lv, tr) if tier is None else tier.when(F.col("level") == lv, tr)
    return df.withColumn("level_name", name).withColumn("tier", tier)


def escalate(df: DataFrame, floor: float = 0.35) -> DataFrame:
    """One level up when the confidence is under the floor."""
    fail = (F.col("level") < 4) & (F.col("confidence") < floor)
    out = df.withColumn("reasons", F.when(fail, F.array_append("reasons", F.lit("confidence_fail"))).otherwise(F.col("reasons")))
    return with_level_names(out.withColumn("level", F.when(fail, F.col("level") + 1).otherwise(F.col("level")).cast("int")))
