"""Entity mentions, stated relations and salience from passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lexicon import lexicon_join

# Mention and relation patterns, confidences, the review bar.
CAPITALISED = r"\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,3})\b"
CAP_STOP = "The This That These Those It A An In On For To And".split()
RELATIONS = [
    (r"(?i)^(.+?)\s+(?:requires|depends on)\s+(.+)", "depends_on"),
    (r"(?i)^(.+?)\s+(?:verifies|validates|covers)\s+(.+)", "verifies"),
    (r"(?i)^(.+?)\s+(?:complies with|conforms to)\s+(.+)", "complies_with"),
    (r"(?i)^(.+?)\s+(?:belongs to|is part of)\s+(.+)", "belongs_to"),
]
LEXICON_CONFIDENCE, CONCEPT_CONFIDENCE, RELATION_CONFIDENCE, REVIEW_BELOW = 0.9, 0.5, 0.7, 0.55
FUNCTIONAL = ("complies_with", "belongs_to")
SALIENT = {
    "requirement": 1.0, "traceability": 1.0, "coverage": 0.9, "defect": 0.9, "regression": 0.8, "release": 0.7,
    "acceptance": 0.9, "verification": 0.9, "test": 0.6, "plan": 0.5, "risk": 0.8, "compliance": 0.9,
}
LEXICON = {
    "requirement": "Requirement", "test case": "TestCase", "test plan": "TestPlan", "defect": "Defect",
    "release": "Release", "component": "Component", "standard": "Standard",
}


def word_mask(c: Column) -> Column:
    """Letters outside ASCII become ``_``, so that word boundaries fall where they do in the text."""
    return F.regexp_replace(c, r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]", "_")


def lexicon_mentions(passages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pack keywords (term, type) contained in the lower-cased passage text: confidence 0.9."""
    low = passages.select("passage_id", F.lower("text").alias("_low"))
    hit = lexicon_join(lexicon, "term", low, "_low")
    return hit.select("passage_id", F.col("term").alias("key"), "type", F.lit(LEXICON_CONFIDENCE).alias("confidence"))


def capitalised_mentions(passages: DataFrame) -> DataFrame:
    """Runs of one to four capitalised words, as Concept mentions of confidence 0.5."""
    found = F.regexp_extract_all(word_mask(F.col("text")), F.lit(CAPITALISED), F.lit(1))
    p = passages.select("passage_id", F.explode(F.array_distinct(found)).alias("phrase"))
    p = p.where(~F.col("phrase").isin(*CAP_STOP) & (F.length("phrase") >= 3))
    return p.select("passage_id", F.lower("phrase").alias("key"), F.lit("Concept").alias("type"), F.lit(CONCEPT_CONFIDENCE).alias("confidence")).distinct()


def mentions(passages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One mention per (passage, key); a lexicon hit wins over a capitalised phrase."""
    a, b = lexicon_mentions(passages, lexicon), capitalised_mentions(passages)
    return a.unionByName(b).groupBy("passage_id", "key").agg(
        F.max_by("type", "confidence").alias("type"), F.max("confidence").alias("confidence")
    )


def _norm(c: Column) -> Column:
    w = F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z0-9 ]", " ")), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, 1, 5), " ")


def relations(passages: DataFrame) -> DataFrame:
    """Stated relations per sentence: (passage_id, sentence, src, relation, dst, confidence)."""
    s = passages.select("passage_id", F.posexplode(F.split("text", r"[.\n]")).alias("sentence", "_s"))
    s = s.withColumn("_s", F.regexp_replace("_s", r"^\s+|\s+$", ""))
    cand = F.array_compact(F.array(*[
        F.when(F.col("_s").rlike(p), F.struct(
            F.lit(r).alias("relation"), _norm(F.regexp_extract("_s", p, 1)).alias("src"), _norm(F.regexp_extract("_s", p, 2)).alias("dst")))
        for p, r in RELATIONS
    ]))
    out = s.select("passage_id", "sentence", F.explode(cand).alias("r")).where("r.src <> '' and r.dst <> ''")
    return out.select("passage_id", "sentence", "r.src", "r.relation", "r.dst", F.lit(RELATION_CONFIDENCE).alias("confidence"))


def salience(passages: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sum of vocabulary weights per (passage, term); words are runs of letters."""
    w = passages.select("passage_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    hit = w.join(vocab, "term")
    return hit.groupBy("passage_id", "term").agg(F.round(F.sum("weight"), 6).alias("score"))


def low_confidence(found: DataFrame) -> DataFrame:
    return found.where(F.col("confidence") < REVIEW_BELOW)


def resolve_entities(found: DataFrame) -> DataFrame:
    """One node per (key, type) with its first mention; ``found`` carries ``arrival``, a total order."""
    return found.groupBy("key", "type").agg(F.min_by("passage_id", "arrival").alias("first_passage"), F.count(F.lit(1)).alias("mentions")).withColumn(
        "node_id", F.substring(F.sha2(F.concat_ws("\u0000", "key", "type"), 256), 1, 24)
    )


def concept_backfill(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Relation endpoints without a node become Concepts."""
    ends = rels.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    return ends.join(nodes.select("key"), "key", "left_anti").withColumn("type", F.lit("Concept"))


def contradiction_flags(edges: DataFrame) -> DataFrame:
    """Flag a functional relation whose source already pointed elsewhere.

    ``edges``: (src, relation, dst, arrival). An edge is in conflict when some earlier edge of the
    same (src, relation) has another target. That needs only the first edge of the group and the
    first one with a different target, two aggregates, not the group's edges in one window.
    """
    fun = edges.where(F.col("relation").isin(*FUNCTIONAL))
    per = fun.groupBy("src", "relation", "dst").agg(F.min("arrival").alias("a"))
    first = per.groupBy("src", "relation").agg(F.min(F.struct("a", "dst")).alias("f"))
    nxt = per.join(first, ["src", "relation"]).where(F.col("dst") != F.col("f.dst")).groupBy("src", "relation").agg(F.min("a").alias("second"))
    j = edges.join(first, ["src", "relation"], "left").join(nxt, ["src", "relation"], "left")
    earlier = F.when(F.col("dst") == F.col("f.dst"), F.col("second")).otherwise(F.col("f.a"))
    return j.select(*edges.columns, F.coalesce(earlier < F.col("arrival"), F.lit(False)).alias("conflict"))


def keyword_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))
