"""Lexical retrieval: questions joined with passages through a token index."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..session import cut_lineage
from .skew import per_key, shuffled, top_k

# BM25 constants.
K1, B = 1.5, 0.75


@dataclass(frozen=True)
class LexicalIndex:
    """Token tables over visible live passages, one set of statistics per access class."""

    postings: DataFrame  # access, passage_id, term, tf, dl
    terms: DataFrame  # access, term, df
    stats: DataFrame  # access, n, avgdl


def access_key(accessible: Column) -> Column:
    return F.array_join(F.array_sort(accessible), ",")


def visible_passages(passages: DataFrame, classes: DataFrame) -> DataFrame:
    """Passages once per access class that may see them.

    ``classes`` has (access, accessible array). The class list is matched against the *distinct*
    ACL sets, so the passages themselves only meet one small equi join and keep their partitions.
    """
    sets = passages.select(access_key(F.col("acl")).alias("acl_key"), "acl").distinct()
    sets = sets.select("acl_key", F.explode("acl").alias("label"))
    cls = classes.select("access", F.explode("accessible").alias("label"))
    allowed = sets.join(cls, "label").select("acl_key", "access").distinct()
    return passages.withColumn("acl_key", access_key(F.col("acl"))).join(allowed, "acl_key").drop("acl_key")


def build_index(passages: DataFrame, vocabulary: DataFrame | None = None) -> LexicalIndex:
    """Token tables from (access, passage_id, text).

    ``vocabulary`` (one ``term`` column) keeps only postings a question can touch; passage lengths
    and averages always count every token.
    """
    toks = passages.select("access", "passage_id", tokens("text").alias("toks"))
    toks = toks.select("access", "passage_id", F.size("toks").cast("long").alias("dl"), "toks")
    stats = toks.groupBy("access").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl")
    )
    occ = toks.select("access", "passage_id", "dl", F.explode("toks").alias("term"))
    if vocabulary is not None:
        occ = occ.join(vocabulary, "term", "left_semi")
    postings = occ.groupBy("access", "passage_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = postings.groupBy("access", "term").agg(F.count(F.lit(1)).alias("df"))
    return LexicalIndex(postings, terms, stats)


def stored_index(idx: LexicalIndex) -> LexicalIndex:
    """The same index with its postings written to the checkpoint folder."""
    postings = cut_lineage(idx.postings)
    terms = postings.groupBy("access", "term").agg(F.count(F.lit(1)).alias("df"))
    return LexicalIndex(postings, terms, idx.stats)


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _part(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


BROADCAST_QUESTIONS = 4096  # question rows that may travel with the tasks
BROADCAST_CELLS = 20_000_000  # largest (terms x questions) weight matrix that may travel


def bm25_topk(questions: DataFrame, passages: DataFrame, k: int, rare_share: float = 0.1, way: str = "auto") -> DataFrame:
    """BM25 top ``k`` passages per question.

    ``questions``: (query_id, text, accessible array); ``passages``: (passage_id, text, acl array),
    live rows only. Access is applied before any statistic is taken, so document frequency and
    mean length are those of the passages the asker may see.

    A bounded question set (both limits above are checked) is turned into a weight matrix that is
    shipped to the scan: two passes over the passages, one for document frequencies and one for
    scores, no shuffle of postings, and k rows per question and batch leave a task. Any larger set
    takes the relational way, see ``_relational``. ``way`` forces one of matrix, pruned or plain.
    """
    qs = questions.withColumn("access", access_key(F.col("accessible")))
    seen = visible_passages(passages, qs.select("access", "accessible").dropDuplicates(["access"]))
    if way in ("auto", "matrix"):
        held = qs.select("query_id", "access", "text").limit(BROADCAST_QUESTIONS + 1).toPandas()
        terms = {t for x in held["text"] for t in _words(x)}
        if way == "matrix" or (len(held) <= BROADCAST_QUESTIONS and len(terms) * max(1, len(held)) <= BROADCAST_CELLS):
            return _ranked(_matrix_scores(held, sorted(terms), seen.select("access", "passage_id", "text"), k), k)
    return _relational(qs, seen, k, rare_share, way != "plain")


_WORD = re.compile(TOKEN)


def _words(text: str) -> list[str]:
    return _WORD.findall((text or "").lower())


def _matrix_scores(held: pd.DataFrame, terms: list[str], seen: DataFrame, k: int) -> DataFrame:
    """Scores of the best ``k`` passages per question and batch, by one matrix product per block of passages."""
    ids = {t: i for i, t in enumerate(terms)}
    sc = seen.sparkSession.sparkContext
    vocab = sc.broadcast(ids)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for access, part in b.groupby("access"):
                freq = np.zeros(len(vocab.value), dtype=np.int64)
                total = 0
                for text in part["text"]:
                    w = _words(text)
                    total += len(w)
                    hit = {vocab.value[t] for t in set(w) if t in vocab.value}
                    freq[list(hit)] += 1
                nz = np.nonzero(freq)[0]
                rows = [(access, int(i), int(freq[i])) for i in nz] + [(access, -1, len(part)), (access, -2, total)]
                yield pd.DataFrame(rows, columns=["access", "term", "n"])

    stats = seen.mapInPandas(count, "access string, term int, n long").groupBy("access", "term").agg(F.sum("n").alias("n")).toPandas()
    plans = {}
    for access, mine in held.groupby("access"):
        got = dict(zip(stats.loc[stats["access"] == access, "term"], stats.loc[stats["access"] == access, "n"]))
        n = got.get(-1, 0)
        if not n:
            continue
        used = sorted({ids[t] for x in mine["text"] for t in _words(x)})
        col = {t: i for i, t in enumerate(used)}
        w = np.zeros((len(used), len(mine)))
        for j, x in enumerate(mine["text"]):
            for t in _words(x):
                df = got.get(ids[t], 0)
                w[col[ids[t]], j] += math.log(1 + (n - df + 0.5) / (df + 0.5))
        plans[access] = (w, {terms[t]: c for t, c in col.items()}, mine["query_id"].to_numpy(), got.get(-2, 0) / n)
    shipped = sc.broadcast(plans)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for access, part in b.groupby("access"):
                if access not in shipped.value:
                    continue
                w, col, qids, avgdl = shipped.value[access]
                step = max(16, 2_000_000 // max(1, w.shape[0]))
                for lo in range(0, len(part), step):
                    block = part.iloc[lo : lo + step]
                    tf = np.zeros((len(block), w.shape[0]))
                    dl = np.zeros(len(block))
                    for r, text in enumerate(block["text"]):
                        toks = _words(text)
                        dl[r] = len(toks)
                        tf[r] = np.bincount([col[t] for t in toks if t in col], minlength=w.shape[0])
                    r, c = np.nonzero(tf)
                    v = tf[r, c]
                    tf[r, c] = v * (K1 + 1) / (v + K1 * (1 - B + B * dl[r] / avgdl))
                    s = np.round(tf @ w, 6)
                    pid = block["passage_id"].to_numpy()
                    order = np.lexsort((np.broadcast_to(pid[:, None], s.shape), -s), axis=0)[:k]
                    top = np.take_along_axis(s, order, axis=0)
                    rows, cols = np.nonzero(top > 0)
                    yield pd.DataFrame({"query_id": qids[cols], "passage_id": pid[order[rows, cols]], "score": top[rows, cols]})

    return seen.mapInPandas(score, "query_id long, passage_id long, score double")


def _relational(qs: DataFrame, seen: DataFrame, k: int, rare_share: float, prune: bool) -> DataFrame:
    """The same list by joins, for question sets of any size.

    Common words would pair nearly every passage with every question. With ``prune`` the scoring
    runs in two steps and stays exact: terms occurring in at most ``rare_share`` of the passages
    give each question a lower bound of its k-th best score; a passage without any term outside
    the tail whose summed upper bounds stay under that bound cannot reach the list, so the tail
    terms are looked up for the remaining candidates only, by passage and not by term.
    """
    occ = qs.select("query_id", "access", F.explode(tokens("text")).alias("term"))
    qterms = occ.groupBy("query_id", "access", "term").agg(F.count(F.lit(1)).alias("qtf"))
    idx = build_index(seen, occ.select("term").distinct())
    if prune:  # the postings are read several times: write them once instead of tokenising again
        idx = stored_index(idx)
    weights = qterms.join(idx.terms, ["access", "term"]).join(idx.stats, "access")
    weights = weights.select(
        "query_id", "access", "term", "avgdl", "df", "n",
        (F.col("qtf") * _idf(F.col("n"), F.col("df"))).alias("w"),
    )
    score = F.sum(F.col("w") * _part(F.col("tf"), F.col("dl"), F.col("avgdl")))
    if not prune:
        hits = idx.postings.join(weights, ["access", "term"])
        return _ranked(hits.groupBy("query_id", "passage_id").agg(score.alias("score")), k)

    rare = weights.where(F.col("df") <= F.lit(rare_share) * F.col("n"))
    seen = idx.postings.join(rare, ["access", "term"]).groupBy("query_id", "passage_id").agg(score.alias("score"))
    seen = top_k(seen, ["query_id"], [F.desc("score"), F.col("passage_id")], k)
    floor = seen.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score") - 1e-5).otherwise(0.0).alias("floor")
    )
    # ub: largest contribution of this and every more common term of the question
    tail = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    bounded = weights.withColumn("tail_ub", F.sum(F.col("w") * (K1 + 1)).over(tail)).join(floor, "query_id", "left")
    needed = bounded.where(F.col("tail_ub") >= F.coalesce("floor", F.lit(0.0))).select(*weights.columns)
    cands = idx.postings.join(needed.select("query_id", "access", "term"), ["access", "term"])
    cands = cands.groupBy("query_id", "access", "passage_id").agg(F.max("dl").alias("_dl"))
    full = cands.join(weights, ["query_id", "access"])
    hits = full.join(idx.postings, ["access", "passage_id", "term"])
    return _ranked(hits.groupBy("query_id", "passage_id").agg(score.alias("score")), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    out = scored.select("query_id", "passage_id", F.round("score", 6).alias("score")).where("score > 0")
    return top_k(out, ["query_id"], [F.desc("score"), F.col("passage_id")], k)


#: Characters of a needle that are met exactly; the rest of a longer one is verified.
KEY = 16


def contains_join(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """All (needle row, hay row) pairs with ``needle`` a substring of ``text``, without a cross join.

    A text can only hold a needle when it holds the needle's first characters (three of them, or all
    of a shorter needle); grams no needle starts with never leave the text's task. What follows the others in
    the text, in the lengths that needles have, meets the needles cut to ``KEY`` characters; longer ones are verified.
    """
    n = needles.where(F.length(needle) > 0).withColumn("_key", F.substring(needle, 1, KEY))
    starts = n.select(F.substring(needle, 1, 3).alias("_gram")).distinct()
    lengths = sorted(r[0] for r in n.select(F.length("_key")).distinct().collect())  # KEY numbers at most
    slide = lambda k: F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(.{%d}))." % k), F.lit(1))
    grams = F.array_distinct(F.concat(slide(3), *[slide(k) for k in (2, 1) if k in lengths]))
    h = hay.withColumn("_gram", F.explode(grams)).join(starts, "_gram", "left_semi")
    quoted = F.concat(F.lit("(?s)(?=(\\Q"), F.replace("_gram", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E.{0,%d}))." % (KEY - 3)))
    size = F.length("_gram")
    cut = lambda p: F.array(*[F.when((F.length(p) >= k) & ((size == k) | (size == 3) & F.lit(k > 3)), F.substring(p, 1, k)) for k in lengths], F.lit(None).cast("string"))
    keys = F.array_distinct(F.array_compact(F.flatten(F.transform(F.regexp_extract_all(F.col(text), quoted, F.lit(1)), cut))))
    h = h.withColumn("_key", F.explode(keys)).drop("_gram")
    return h.join(per_key(n), "_key").where(F.col(text).contains(F.col(needle))).drop("_key")


def identifier_hits(qtokens: DataFrame, assets: DataFrame, weights: dict[str, int], first_only: bool) -> DataFrame:
    """Identifier score of (query_id, passage_id): tokens found inside the named asset columns.

    ``qtokens``: distinct (query_id, token). With ``first_only`` a token counts once, for the
    heaviest column it occurs in; otherwise every column it occurs in adds its weight.
    """
    parts = []
    vocab = qtokens.select("token").distinct()
    for col, w in weights.items():
        hay = assets.select("passage_id", F.lower(F.coalesce(F.col(col), F.lit(""))).alias("_text"))
        parts.append(contains_join(vocab, "token", hay, "_text").select("token", "passage_id", F.lit(w).alias("w")))
    tier = parts[0]
    for p in parts[1:]:
        tier = tier.unionByName(p)
    agg = F.max("w") if first_only else F.sum("w")
    tier = tier.groupBy("token", "passage_id").agg(agg.alias("w"))
    hits = qtokens.join(shuffled(tier), "token").groupBy("query_id", "passage_id")
    return hits.agg(F.sum("w").cast("double").alias("score"))


def asset_search(lexical: DataFrame, qtokens: DataFrame, assets: DataFrame, k: int) -> DataFrame:
    """Best hit per document from BM25 hits and an identifier tier, then the top ``k``.

    ``lexical``: (query_id, passage_id, score). ``qtokens``: (query_id, token of 3+ characters).
    ``assets``: (passage_id, document_id, symbol, path); a symbol hit weighs 3, a path hit 1.
    """
    ident = identifier_hits(qtokens.distinct(), assets, {"symbol": 3, "path": 1}, first_only=False)
    both = lexical.select("query_id", "passage_id", "score").unionByName(ident)
    both = both.join(assets.select("passage_id", "document_id"), "passage_id")
    best = both.groupBy("query_id", "document_id").agg(
        F.max(F.struct(F.col("score"), (-F.col("passage_id")).alias("p"))).alias("b")
    )
    best = best.select("query_id", "document_id", (-F.col("b.p")).alias("passage_id"), F.col("b.score").alias("score"))
    return top_k(best, ["query_id"], [F.desc("score"), F.col("document_id")], k)


def code_answer(
    qtokens: DataFrame, code: DataFrame, emphasis: str = "none", blocks: int = 2, max_chars: int = 1800
) -> DataFrame:
    """Code blocks answering each question, when some symbol name is hit (score 3 or more).

    ``code``: (passage_id, document_id, symbol, qualified, path, summary_line, text). The four best
    passages are re-ordered by the reader's emphasis (``test`` or ``code``), then by score.
    """
    hits = identifier_hits(qtokens.distinct(), code, {"symbol": 3, "qualified": 2, "path": 1}, first_only=True)
    top = top_k(hits, ["query_id"], [F.desc("score"), F.col("passage_id")], 4, "_r")
    strong = Window.partitionBy("query_id")
    top = top.withColumn("_best", F.max("score").over(strong)).where("_best >= 3").join(code, "passage_id")
    is_test = F.lower("path").contains("test")
    bias = {"test": is_test.cast("int"), "code": (~is_test).cast("int")}.get(emphasis, F.lit(0))
    top = top_k(top, ["query_id"], [bias.desc(), F.desc("score"), F.col("passage_id")], max(1, min(2, blocks)), "block")
    body = F.when(
        F.length("text") > max_chars,
        F.concat(F.rtrim(F.substring("text", 1, max_chars)), F.lit("\n# ... (truncated)")),
    ).otherwise(F.col("text"))
    return top.select("query_id", "block", "document_id", "passage_id", "score", "summary_line", body.alias("body"))


def merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """Discovery fan-out: hits of several searchers, one per (query, key), best score wins.

    The key of a hit is its url, else its passage, else its path.
    """
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("passage_id").cast("string"), F.col("path"))
    one = hits.withColumn("hit_key", key).groupBy("query_id", "hit_key").agg(
        F.max(F.struct("score", "searcher")).alias("b")
    )
    one = one.select("query_id", "hit_key", F.col("b.score").alias("score"), F.col("b.searcher").alias("searcher"))
    return top_k(one, ["query_id"], [F.desc("score"), F.col("hit_key")], k)


# Wording that asks whether something exists to find or reuse.
DISCOVERY = (
    r"(?i)\b(has|have)\s+(anyone|we|someone|any\s?one)\b"
    r"|\b(is|are)\s+there\b|\bdo\s+we\s+have\b"
    r"|\bcan\s+i\s+(find|reuse|use|get)\b|\bwhere\s+(can|do)\s+i\s+find\b"
    r"|\bfind\s+(me\s+)?(a|an|the|some|any)\b|\blook(ing)?\s+for\b|\bsearch\s+for\b"
    r"|\breus(e|able)\b|\bexample[s]?\s+of\b|\bexisting\b|\bany\s+(code|script|module|library|example)\b"
)


def is_discovery(question: Column) -> Column:
    return question.rlike(DISCOVERY)


def reading_order() -> list[Column]:
    """Total order of passages inside a document."""
    return [F.col(c).asc_nulls_last() for c in ("page", "paragraph", "line", "start")] + [F.col("passage_id")]


def page_read(passages: DataFrame, limit_chars: int = 12_000) -> DataFrame:
    """Text of each (document_id, page) in reading order, cut to ``limit_chars``.

    Every passage gets its running offset first; only the passages that start inside the limit
    are gathered, so a page of any length stays within the limit in one row.
    """
    w = Window.partitionBy("document_id", "page").orderBy(*reading_order()).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    kept = passages.withColumn("_off", off).where(F.col("_off") < limit_chars)
    parts = F.array_sort(F.collect_list(F.struct("_off", "text")))
    out = kept.groupBy("document_id", "page").agg(parts.alias("_p"), F.count(F.lit(1)).alias("passages"))
    text = F.array_join(F.transform("_p", lambda x: x["text"]), "\n\n")
    return out.select("document_id", "page", "passages", F.substring(text, 1, limit_chars).alias("text"))


def citation_context(passages: DataFrame, radius: int = 1) -> DataFrame:
    """Each passage with its neighbours in reading order, ``radius`` on each side."""
    w = Window.partitionBy("document_id").orderBy(*reading_order())
    before = [F.lag("passage_id", i).over(w) for i in range(radius, 0, -1)]
    after = [F.lead("passage_id", i).over(w) for i in range(1, radius + 1)]
    return passages.select(
        "document_id", "passage_id",
        F.array_compact(F.array(*before)).alias("before"),
        F.array_compact(F.array(*after)).alias("after"),
    )
