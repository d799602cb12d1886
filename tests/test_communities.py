"""Modularity communities against plain Python: hand graphs, and optima that no move and no merger betters."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from groundwork.operators import communities as M
from groundwork.operators import graph as G


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    e = spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")
    return spark.createDataFrame([(i,) for i in ids], "node long"), e


def score(com, pairs):
    m, deg = len(pairs), Counter(x for p in pairs for x in p)
    vol = Counter()
    for n, d in deg.items():
        vol[com[n]] += d
    return Fraction(sum(com[a] == com[b] for a, b in pairs), m) - sum(Fraction(v, 2 * m) ** 2 for v in vol.values())


def test_triangles_with_a_bridge_and_a_star(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)] + [(100, 100 + i) for i in range(1, 14)]
    n, e = graph(spark, pairs, [999])
    e = e.unionByName(spark.createDataFrame([(2, 1), (7, 7), (1, 12345), (None, 3)], "src long, dst long"))  # repeats, loops, strangers, nulls
    got = {r.node: r.community for r in M.modularity_communities(n.unionByName(n.limit(3)), e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 999: 999} | {i: 100 for i in range(100, 114)}
    groups = spark.createDataFrame(list(got.items()), "node long, community long")
    c = {r.community: r for r in M.modularity(groups, e).collect()}
    assert (c[1].size, c[1].internal, c[1].volume) == (3, 3, 7) and c[999].modularity == 0.0
    assert sum(r.modularity for r in c.values()) == pytest.approx(float(score(got, pairs)))


def test_no_move_and_no_merger_gains(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(8 * k, 8 * k + 8), 2))) for k in range(3) for _ in range(18)} | {tuple(sorted(r.sample(range(24), 2))) for _ in range(12)})
    n, e = graph(spark, pairs)
    com = {x.node: x.community for x in M.modularity_communities(n, e).collect()}
    best = score(com, pairs)
    spread = {x.node: x.community for x in G.communities(n, e).collect()}
    assert best >= score(spread, pairs) and all(c == min(k for k in com if com[k] == c) for c in com.values())
    names = set(com.values())
    assert all(score({**com, k: c}, pairs) <= best for k in com for c in names)
    assert all(score({k: a if c == b else c for k, c in com.items()}, pairs) <= best for a in names for b in names)


def test_empty_tables(spark):
    n, e = spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long")
    assert M.modularity_communities(n, e).count() == 0 and M.modularity(n.selectExpr("node", "node as community"), e).count() == 0
    one = spark.createDataFrame([(7,), (None,)], "node long")
    assert [tuple(r) for r in M.modularity_communities(one, e).collect()] == [(7, 7)]


def test_shares_of_no_edges_are_not_a_number(spark):
    """As 0 / 0 is in the SQL of community_modularity, whose graph loses its edges as the tables grow."""
    n, e = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, community long"), spark.createDataFrame([(2, 2), (3, 4)], "src long, dst long")
    got = {r.community: r for r in M.modularity(n, e).collect()}
    assert {k: (r.size, r.internal, r.volume) for k, r in got.items()} == {1: (2, 0, 0), 3: (1, 0, 0)}
    assert all(math.isnan(r.modularity) for r in got.values())
