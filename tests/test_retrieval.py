"""Ranking against brute force, both ways of each operator, and plan shapes."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.functions.udfs import _Slots, embed_text, hash_embed
from groundwork.operators import fusion, guards, retrieval, vectors

WORDS = "alpha beta gamma delta cache index graph node the of and".split()


def corpus(n=120, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(3, 40))] + ([f"rare{i % 7}"] if i % 5 == 0 else [])
        out.append((i, " ".join(w), ["public"] if i % 3 else ["restricted"]))
    return out


QUESTIONS = [(1, "the cache index", ["public"]), (2, "rare3 of graph graph", ["public", "restricted"]), (3, "nothing here", ["public"])]


def brute_bm25(docs, q, acl, k):
    seen = [(i, t.split()) for i, t, a in docs if set(a) & set(acl)]
    n, avg = len(seen), sum(len(t) for _, t in seen) / len(seen)
    df = Counter(w for _, t in seen for w in set(t))
    out = []
    for i, t in seen:
        tf, s = Counter(t), 0.0
        for w in q.split():
            if w in tf:
                s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out.append((round(s, 6), i))
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("way", ["matrix", "pruned", "plain"])
def test_bm25_ways_agree_with_brute_force(spark, way):
    docs = corpus()
    p = spark.createDataFrame(docs, "passage_id long, text string, acl array<string>")
    q = spark.createDataFrame(QUESTIONS, "query_id long, text string, accessible array<string>")
    got = {}
    for r in retrieval.bm25_topk(q, p, 5, way=way).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.passage_id, r.score))
    for qid, text, acl in QUESTIONS:
        want = brute_bm25(docs, text, acl, 5)
        assert [(p_, s) for _, p_, s in sorted(got.get(qid, []))] == want


def test_restricted_passage_never_ranks(spark):
    p = spark.createDataFrame(corpus(), "passage_id long, text string, acl array<string>")
    q = spark.createDataFrame([(1, "alpha beta gamma", ["public"])], "query_id long, text string, accessible array<string>")
    hits = {r.passage_id for r in retrieval.bm25_topk(q, p, 200).collect()}
    assert hits and all(i % 3 for i in hits)


def test_access_filter_sits_below_scoring(spark):
    """The scoring pass reads a join with the visible ACL sets, and nothing is a cartesian product."""
    p = spark.createDataFrame(corpus(), "passage_id long, text string, acl array<string>")
    q = spark.createDataFrame(QUESTIONS, "query_id long, text string, accessible array<string>")
    plan = retrieval.bm25_topk(q, p, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert plan.index("MapInPandas") < plan.index("Join")


def test_blocked_cosine_equals_broadcast(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, [float(x) for x in r], i // 3) for i, r in enumerate(m)], "id long, vec array<double>, document_id long")
    a = vectors.cosine_topk(v, v, 4, different="document_id")
    from groundwork.operators.skew import top_k

    b = top_k(vectors._blocked_topk(v, v, 4, "document_id", "query_id long, id long, score double"), ["query_id"], [F.desc("score"), F.col("id")], 4)
    key = lambda d: sorted((r.query_id, r["rank"], r.id, r.score) for r in d.collect())
    assert key(a) == key(b)
    sims = np.round(m @ m.T, 6)
    got = [(r.id, r.score) for r in a.where("query_id = 7").orderBy("rank").collect()]
    want = sorted(((-sims[7, j], j) for j in range(90) if j // 3 != 2))[:4]
    assert got == [(j, -s) for s, j in want]


@pytest.mark.parametrize("block", [3, 2048])
def test_near_duplicates_exact_with_hot_group(spark, monkeypatch, block):
    """A third of the vectors are copies of one; the result equals brute force for any block size and centres."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 6))
    m[:20] = m[0] + rng.normal(scale=0.02, size=(20, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, i // 2, (i * 7) % 11, [float(x) for x in r]) for i, r in enumerate(m)]
    v = spark.createDataFrame(rows, "id long, document_id long, seq long, vec array<double>")
    sims, want = m @ m.T, {}
    for i, di, si, _ in rows:
        hits = [(s, d, j) for j, d, s, _ in rows if d != di and sims[i, j] >= 0.92]
        if hits:
            older = [h for h in hits if (h[0], h[1]) < (si, di)]
            want[i] = (min(hits)[2] if older else None, len(older), len(hits) - len(older))
    for centres in (1, 5):
        got = {r.id: (r.dup_of, r.originals, r.copies) for r in vectors.near_duplicates(v, 0.92, centres).collect()}
        assert got == want and len(want) >= 20


def test_embedder_matches_definition(spark):
    import hashlib

    text = "Index the index, now"
    vec = [0.0] * 256
    toks = ["index", "the", "index", "now"]
    for f in toks + ["index_the", "the_index", "index_now"]:
        h = hashlib.blake2b(f.encode(), digest_size=8).digest()
        vec[int.from_bytes(h[:4], "big") % 256] += 1.0 if h[4] & 1 else -1.0
    n = math.sqrt(sum(x * x for x in vec))
    assert np.allclose(embed_text(text, _Slots()), np.array(vec) / n)
    got = spark.createDataFrame([(text,), ("",)], "t string").select(hash_embed("t").alias("v")).collect()
    assert np.allclose(got[0].v, np.array(vec) / n) and not any(got[1].v)


def test_mmr_greedy(spark):
    vecs = [[1.0, 0.0], [0.99, math.sqrt(1 - 0.99**2)], [0.0, 1.0]]
    rows = [(1, i, i, 0.01 - 0.001 * i, 0.9 - 0.2 * i, vecs[i]) for i in range(3)]
    c = spark.createDataFrame(rows, "query_id long, id long, pos long, fused double, vscore double, vec array<double>")
    got = [r.id for r in vectors.mmr(c, 2).orderBy("pick").collect()]
    rel = [0.5 * r[4] + 0.5 * min(1.0, 100 * r[3]) for r in rows]
    second = max((1, 2), key=lambda j: 0.7 * rel[j] - 0.3 * np.dot(vecs[j], vecs[0]))
    assert got == [0, second]


def test_authority_boost_keeps_ties(spark):
    f = spark.createDataFrame([(1, 10, 0.5, 0), (1, 11, 0.5, 1), (1, 12, 0.5, 2)], "query_id long, passage_id long, fused double, idx long")
    docs = spark.createDataFrame([(10, 1, "jira"), (11, 2, "files"), (12, 3, "files")], "passage_id long, document_id long, source string")
    ranks = spark.createDataFrame([("jira", fusion.DEFAULT_RANKS["jira"], 0.571429), ("files", 1, 1.0)], "source string, rank int, weight double")
    marks = spark.createDataFrame([(1, True)], "document_id long, authoritative boolean")
    got = [r.passage_id for r in fusion.authority_boost(f, docs, ranks, marks).orderBy("rank").collect()]
    assert got == [11, 12, 10]


def test_contains_join_finds_every_pair(spark):
    needles = ["a", "ab", "abc", "zz", "cache", "é"]
    texts = ["xxabcxx", "cach", "the cache é", "", "zzz"]
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    h = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {(r.n, r.id) for r in retrieval.contains_join(n, "n", h, "t").collect()}
    assert got == {(x, i) for x in needles for i, t in enumerate(texts) if x in t}


def test_guards(spark):
    df = spark.createDataFrame([("t1", 1)], "tenant string, x long")
    with pytest.raises(ValueError):
        guards.tenant_guard(df, "")
    assert guards.tenant_guard(df, "t1").count() == 1
    got = df.select(guards.accessible_acls(F.array(F.lit("b"), F.lit("a")))).first()[0]
    assert got == ["a", "b", "public"]
