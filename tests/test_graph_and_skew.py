"""Graph operators against hand values and brute force; block, rank and interval helpers."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators import graph as G
from groundwork.operators import names, telemetry
from groundwork.operators.skew import floor_index, nearest_rank, pair_blocks, round_index

TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)] + [(100, 100 + i) for i in range(1, 14)]


def edges(spark, pairs, relation="depends_on"):
    return spark.createDataFrame([(a, b, relation) for a, b in pairs], "src long, dst long, relation string")


def aa(adj, a, b):
    return sum(1 / math.log(len(adj[m])) for m in adj[a] & adj[b] if len(adj[m]) > 1)


def adjacency(pairs):
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return adj


def test_adamic_adar_diamond(spark):
    e = edges(spark, [(1, 2), (1, 3), (4, 2), (4, 3)])
    p = spark.createDataFrame([(1, 4), (2, 3), (1, 2)], "a long, b long")
    got = {(r.a, r.b): r.aa for r in G.adamic_adar(p, G.adjacency(e)).collect()}
    assert got[(1, 4)] == pytest.approx(2 / math.log(2)) and got[(1, 2)] == 0.0


def test_components_and_cohesion(spark):
    e = edges(spark, TRIANGLES)
    ids = sorted({x for p in TRIANGLES for x in p} | {999})
    n = spark.createDataFrame([(i, f"k{i}", "Concept") for i in ids], "node long, key string, type string")
    comp = {r.node: r.comp for r in G.connected_components(n, e).collect()}
    assert {comp[i] for i in range(1, 7)} == {1} and comp[113] == 100 and comp[999] == 999
    groups = spark.createDataFrame([(i, comp[i]) for i in ids], "node long, community long")
    c = {r.community: r for r in G.cohesion(groups, e).collect()}
    assert c[100].cohesion == pytest.approx(13 / 91, abs=1e-6) and c[100].flag == "low-cohesion" and c[999].flag is None


def random_graph(seed, n=30, m=70):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} | {(0, i) for i in range(1, 20)})


@pytest.mark.parametrize("light", [3, 1000])
def test_surprising_exact_with_heavy_hubs(spark, light):
    pairs = random_graph(2)
    adj = adjacency(pairs)
    com = {i: i % 3 for i in range(30)}
    groups = spark.createDataFrame(list(com.items()), "node long, community long")
    e = edges(spark, [p for i, p in enumerate(pairs) if i % 2]).unionByName(edges(spark, [p for i, p in enumerate(pairs) if i % 2 == 0], "co_occurs"))
    stated = {p for i, p in enumerate(pairs) if i % 2}
    want = sorted(((-round(aa(adj, a, b), 6), a, b) for a, b in itertools.combinations(sorted(adj), 2) if com[a] != com[b] and (a, b) not in stated and aa(adj, a, b) > 0))[:10]
    got = [(-r.adamic_adar, r.a, r.b) for r in G.surprising(groups, e, 10, light).collect()]
    assert got == want


@pytest.mark.parametrize("limit", [3, 64])
def test_relevance_exact_on_both_ways(spark, limit):
    pairs = random_graph(4)
    adj, r = adjacency(pairs), random.Random(9)
    docs = {i: {r.randrange(8) for _ in range(r.randint(0, 3))} for i in range(30)}
    types = {i: ["Concept", "Product", "Service", "Person"][i % 4] for i in range(30)}
    e = edges(spark, pairs[:25]).unionByName(edges(spark, pairs[25:], "co_occurs"))
    stated = set(pairs[:25])

    def affinity(x, y):
        if "Person" in (x, y):
            return 0.15
        return 1.0 if {x, y} == {"Product", "Service"} else 0.5 if x == y == "Concept" else 0.4

    out = []
    for a, b in itertools.combinations(range(30), 2):
        if (a, b) in stated or docs[a] & docs[b] or adj.get(a, set()) & adj.get(b, set()):
            u = docs[a] | docs[b]
            s = aa(adj, a, b) if a in adj and b in adj else 0.0
            w = 0.4 * ((a, b) in stated) + 0.25 * (len(docs[a] & docs[b]) / len(u) if u else 0) + 0.2 * s / (s + 1) + 0.15 * affinity(types[a], types[b])
            out.append((-round(w, 6), a, b))
    n = spark.createDataFrame([(i, types[i]) for i in range(30)], "node long, type string")
    d = spark.createDataFrame([(i, x) for i, ds in docs.items() for x in ds], "node long, document_id long")
    got = [(-r_.weight, r_.a, r_.b) for r_ in G.relevance_edges(n, e, d, limit).collect()]
    assert got == sorted(out)[:limit]


def test_pair_blocks_hot_key(spark):
    rows = [(1, i) for i in range(37)] + [(2, 5), (2, 9), (3, 1)]
    d = spark.createDataFrame(rows, "g long, x long")
    got = sorted((r.g, r.x_a, r.x_b) for r in pair_blocks(d, ["g"], "x", block=4).collect())
    want = sorted((g, a, b) for g in (1, 2) for a, b in itertools.combinations(sorted(x for k, x in rows if k == g), 2))
    assert got == want


@pytest.mark.parametrize("small", [20_000, 0])
def test_nearest_rank_is_exact(spark, small):
    r = random.Random(1)
    rows = [("hot", float(r.randint(0, 500))) for _ in range(25_000)] + [("odd", float(i)) for i in range(7)]
    d = spark.createDataFrame(rows, "k string, v double")
    picks = {"p50": floor_index(0.5), "p95": floor_index(0.95), "r95": round_index(0.95)}
    got = {x.k: x for x in nearest_rank(d, ["k"], "v", picks, small=max(small, 10)).collect()}
    for k in ("hot", "odd"):
        xs = sorted(v for kk, v in rows if kk == k)
        n = len(xs)
        assert got[k].n == n and got[k].p50 == xs[int(n * 0.5)] and got[k].p95 == xs[min(n - 1, int(n * 0.95))] and got[k].r95 == xs[int(round(0.95 * (n - 1)))]


def test_stab_join_equals_brute_force(spark):
    r = random.Random(7)
    iv = [(i, "k" if i % 3 else "j", s := r.uniform(0, 1000), s + r.choice([0, 0.5, 3, 40, 900])) for i in range(60)]
    pt = [(i, "k" if i % 2 else "j", r.uniform(-10, 1200)) for i in range(80)]
    a = spark.createDataFrame(pt, "pid long, key string, t double")
    b = spark.createDataFrame(iv, "iid long, key string, lo double, hi double")
    got = {(x.pid, x.iid) for x in telemetry.stab_join(a, "t", b, "lo", "hi", ["key"]).collect()}
    assert got == {(p, i) for p, k, t in pt for i, kk, lo, hi in iv if k == kk and lo <= t <= hi}


def test_similar_tokens_equals_brute_force(spark):
    from difflib import SequenceMatcher

    r = random.Random(3)
    left = {"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(60)}
    right = {"".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(60)}
    for floor in (0.8, 0.85):
        want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= floor}
        got = {(x.lt, x.rt) for x in names.similar_tokens(*(spark.createDataFrame([(t,) for t in s], "token string") for s in (left, right)), floor).collect()}
        assert got == want


def test_resolve_names(spark):
    al = spark.createDataFrame([("blue bolt", "blue bolt"), ("red widget", "red widget"), ("red wedge", "red wedge")], "name string, alias string")
    q = spark.createDataFrame([(1, "where is the blue bolt kept"), (2, "blu bolt stock"), (3, "red widge"), (4, "green thing")], "query_id long, text string")
    got = {r.query_id: (r.status, r.name) for r in names.resolve_names(q, al).collect()}
    assert got[1] == ("ok", "blue bolt") and got[2] == ("ok", "blue bolt") and got[3][0] == "ambiguous" and got[4][0] == "none"


def test_partition_count_does_not_matter(spark, sf):
    from groundwork.plans.graph import supplier_mentions

    seen = set()
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, G.cooccurrence(supplier_mentions(spark, sf)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
    assert F is not None
