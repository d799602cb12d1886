"""Odd rows of larger tables, and joins whose sides are larger than the planner believes."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.operators import answers, evaluate, graph, names, retrieval, sheets, telemetry, vectors
from groundwork.operators.skew import top_k


def test_active_time_never_exceeds_the_wall_clock(spark):
    d = spark.createDataFrame([(1, 0.0, {"retrieve": 24.0, "compose": 12.0}), (2, 20.0, {"retrieve": 24.0}), (3, 40.0, {"retrieve": 10.0})], "id long, total_ms double, phase_ms map<string,double>")
    got = {r.id: (r.active_ms, r.idle_ms, r.active_pct) for r in telemetry.active_idle(d).collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (20.0, 0.0, 100.0), 3: (10.0, 30.0, 25.0)}


def test_word_boundaries_of_followups_are_ascii(spark):
    turns = spark.createDataFrame([(1, 0, "Falcon"), (1, 1, "and Iequega, domentera. Doñes"), (1, 2, "and Iequega, domentera. Dones")], "conv_id long, turn long, question string")
    sub = spark.createDataFrame([("falcon", "FALCON")], "key string, display string")
    got = {r.turn: r.rule for r in answers.resolve_followups(turns, sub).collect()}
    assert got == {0: "self", 1: "plain", 2: "ellipsis"}


def test_call_rules_in_order_and_no_side_broadcast_by_estimate(spark, tmp_path):
    rows = [
        ("r", "m", "m", "module", None, [], ["lib.h"]), ("r", "m", "m.C", "class", None, [], []), ("r", "m", "m.C.f", "method", "C", ["self.g", "self.no", "h", "k", "x.y", "far", "twice"], []),
        ("r", "m", "m.C.g", "method", "C", [], []), ("r", "m", "m.k", "function", None, ["k"], []), ("r", "lib", "lib.h", "function", None, [], []), ("r", "x", "x.y", "function", None, [], []),
        ("r", "z", "z.far", "function", None, [], []), ("r", "z", "z.k", "function", None, [], []), ("r", "z", "z.twice", "function", None, [], []), ("r", "x", "x.twice", "function", None, [], []), ("q", "z", "z.h", "function", None, ["far"], []),
    ]
    s = spark.createDataFrame(rows, "repo string, module string, qualified string, kind string, cls string, calls array<string>, imports array<string>")
    s.write.parquet(str(tmp_path / "s"))  # a file's small estimate
    s = spark.read.parquet(str(tmp_path / "s"))
    e = graph.call_graph(s)
    assert sorted((r.repo, r.src, r.dst) for r in e.collect()) == [("r", "m.C.f", d) for d in ("lib.h", "m.C.g", "m.k", "x.y", "z.far")]
    d = graph.call_degrees(s.withColumn("path", F.col("module")).withColumn("symbol_kind", F.col("kind")), e)
    assert d.where("qualified = 'm.C.f'").first()["degree"] == 5
    for x in (e, d):
        assert "Broadcast" not in x._jdf.queryExecution().sparkPlan().toString()


def test_points_and_intervals_are_not_broadcast_by_estimate(spark, tmp_path):
    p = spark.createDataFrame([("a", 3), ("a", 9)], "k string, at int")
    i = spark.createDataFrame([("a", 1, 4), ("a", 3, 3)], "k string, lo int, hi int")
    i.write.parquet(str(tmp_path / "i"))  # a file's small estimate
    i = spark.read.parquet(str(tmp_path / "i"))
    j = telemetry.stab_join(p, "at", i, "lo", "hi", ["k"])
    assert sorted((r.at, r.lo) for r in j.collect()) == [(3, 1), (3, 3)]
    assert "Broadcast" not in j._jdf.queryExecution().sparkPlan().toString()


def test_sheet_cells_are_never_the_broadcast_side(spark):
    rows = [("s", r, c, str(r * c) if r else f"h{c}") for r in range(50) for c in range(3)]
    c = spark.createDataFrame(rows, "sheet_id string, row long, col int, value string")
    b = sheets.body(c, sheets.detect_header(c))
    assert b.count() == 147 and sides(b) == {"BuildRight"}
    assert sides(sheets.row_passages(b, sheets.column_names(c, sheets.detect_header(c)))) == {"BuildRight"}
    assert sides(sheets.numeric_ranges(b, sheets.column_types(b))) == {"BuildRight"}


def sides(df):
    return {"Build" + x for x in re.findall(r"Build(Left|Right)", df._jdf.queryExecution().sparkPlan().toString())}


def test_known_questions_broadcast_only_the_registry(spark):
    reg = spark.createDataFrame([(1, 1, "count <kind> birds", ["how many birds"], True), (2, 2, "count birds red", [], True)], "entry_id long, seq long, pattern string, examples array<string>, enabled boolean")
    q = spark.createDataFrame([(1, "How many birds?"), (2, "count red birds now"), (3, "count"), (4, "count birds")], "query_id long, text string")
    m = evaluate.known_question_match(q, reg)
    assert sorted(tuple(r) for r in m.collect()) == [(1, 1, 2, 2), (2, 2, 1, 3), (4, 1, 1, 2)]
    assert sides(m) == {"BuildRight"}


def test_substrings_meet_on_more_than_their_first_characters(spark):
    words = ["lookup12", "lookup123", "a", "b.", "loo", "12", "x\\E", "lookup1234567890abcd", "lookup1234567890abce", "𝒳y"]
    texts = ["see lookup1234 and lookup12", "ab.", "x\\E x\\E", "LOOK", "lookup1234567890abcd!", "𝒳𝒳yz", ""]
    n = spark.createDataFrame([(w,) for w in words], "w string")
    h = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = sorted((r.w, r.id) for r in retrieval.contains_join(n, "w", h, "t").collect())
    assert got == sorted((w, i) for w in words for i, t in enumerate(texts) if w in t)


@pytest.mark.parametrize("threshold", [0.9, 0.2])
def test_near_duplicates_of_wide_vectors_are_neither_replicated_nor_shuffled_in_pairs(spark, monkeypatch, threshold):
    """Brute force gives the same, with the bound of the leading coordinates (high threshold) and without."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "CELLS", 300)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(150, 40)) * np.r_[np.full(32, 3.0), np.full(8, 0.05)]
    m[:30] = m[0] + rng.normal(scale=0.01, size=(30, 40))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert (vectors._basis(m, threshold) is None) == (threshold == 0.2)
    rows = [(i, i // 2, (i * 7) % 11, [float(x) for x in r]) for i, r in enumerate(m)]
    sims, want = m @ m.T, {}
    for i, di, si, _ in rows:
        hits = [(s, d, j) for j, d, s, _ in rows if d != di and sims[i, j] >= threshold]
        if hits:
            older = [h for h in hits if (h[0], h[1]) < (si, di)]
            want[i] = (min(hits)[2] if older else None, len(older), len(hits) - len(older))
    v = spark.createDataFrame(rows, "id long, document_id long, seq long, vec array<double>")
    out = vectors.near_duplicates(v, threshold)
    assert {r.id: (r.dup_of, r.originals, r.copies) for r in out.collect()} == want and len(want) >= 30
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan


def test_blocked_topk_with_ties_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "CELLS", 2000)
    rng = np.random.default_rng(4)
    m = rng.integers(-2, 3, size=(400, 5)) / 4.0  # many equal products
    v = spark.createDataFrame([(i, [float(x) for x in r], i // 3, "ab"[i % 2]) for i, r in enumerate(m)], "id long, vec array<double>, document_id long, label string")
    part = vectors._blocked_topk(v, v, 3, "document_id", "query_id long, id long, score double", "label")
    assert part.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 8
    assert "CoGroup" not in part._jdf.queryExecution().sparkPlan().toString()
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in top_k(part, ["query_id"], [F.desc("score"), F.col("id")], 3).collect())
    sims = np.round(m @ m.T, 6) + 0.0
    want = []
    for i in range(400):
        best = sorted((-sims[i, j], j) for j in range(400) if j // 3 != i // 3 and j % 2 == i % 2)[:3]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want


def test_names_are_resolved_once_per_text(spark, monkeypatch):
    """Pairs of questions and aliases are made per text; each row takes what its own text found, a null text nothing."""
    asked, whole = [], names.similar_tokens

    def seen(left, right, floor):
        asked.append(left.count())
        return whole(left, right, floor)

    monkeypatch.setattr(names, "similar_tokens", seen)
    texts = ["Where is the large rin of brand?", "where is the LARGE rin of brand?", "hot bolt", "nothing", None]
    q = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "query_id long, text string")
    al = spark.createDataFrame([(n, n) for n in ("large ring", "large rod", "hot bolt")], "name string, alias string")
    got = {}
    for r in names.resolve_names(q, al).collect():
        got.setdefault(r.query_id % 5, set()).add((r.status, r.name, r.score))
    assert asked == [7 + 2 + 1]
    ring = {("ok", "large ring", round((1 + 6 / 7) / 2, 6))}
    assert got == {0: ring, 1: ring, 2: {("ok", "hot bolt", 1.0)}, 3: {("none", None, None)}, 4: {("none", None, None)}}


def test_symbols_are_scored_where_they_stand(spark, monkeypatch):
    """Brute force gives the same with ties, many batches and many blocks of queries, and no hits are shuffled."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(names, "BLOCK", 60)
    monkeypatch.setattr(names, "CELLS", 40)
    tops = ["price", "prices", "lookup", "Lookup", "prise", "Ring", None, "look"]
    rows = [(i, f"r{i % 3}", f"src/{'price' if i % 4 else 'm'}{i}.py", tops[i % 8], f"a.{tops[(i * 5) % 8]}", [None, "the Ring price", "é look"][i % 3]) for i in range(120)]
    asks = {f"q{i}": x for i, x in enumerate(["price of the ring", "lookup 1", "prices", "", None, "look price", "lookups"])}
    s = spark.createDataFrame(rows, "symbol_id long, repo string, path string, symbol string, qualified string, docstring string")
    out = names.find_symbols(spark.createDataFrame(list(asks.items()), "query_id string, text string"), s, 5)
    got = sorted((r.query_id, r["rank"], r.symbol_id, r.score) for r in out.collect())
    want = []
    for k, text in asks.items():
        scored = []
        for i, repo, path, *cols in rows:
            name, qualified, doc = ((c or "").lower() for c in cols)
            total = 0.0
            for t in {t for t in re.findall("[a-z0-9]+", (text or "").lower()) if t not in ("of", "the")}:
                inside = t in name or t in qualified
                total += 5 if t == name else 2 if inside else 3 if SequenceMatcher(None, t, name).ratio() >= 0.85 else 0
                total += (t in path) + 0.5 * (t in doc)
            scored.append((-total, repo, path, i))
        want += [(k, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(x for x in scored if x[0])[:5])]
    assert got == sorted(want)
    assert "MapInArrow" in out._jdf.queryExecution().sparkPlan().toString()


def test_leading_coordinates_decide_only_where_they_leave_few_pairs(monkeypatch):
    """Vectors whose first coordinates agree would nearly all be computed pair by pair; single precision leaves the twins, and the result is that of brute force."""
    rng = np.random.default_rng(8)
    m = np.c_[np.full((400, 1), 3.0), rng.normal(size=(400, 31)) * 0.05, rng.normal(size=(400, 32)) * 0.3]
    m[::40] = m[0] + rng.normal(scale=0.01, size=(10, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    t = pa.table({"_b": pa.array([0] * 400, pa.int32()), "id": range(400), "document_id": range(400), "seq": range(400), "cell": [0] * 400, "vec": m.tolist()})
    a = vectors._Side(t, m[:1], np.eye(64)[:, :32])
    assert np.count_nonzero(a.lead @ a.lead.T >= 0.98) > 400 * 400 / 100
    left, _ = vectors._filter(a, a, 0.98)
    assert left.shape == (400, 64) and left.dtype == np.float32
    full, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, x, y: full.append(len(x)) or einsum(how, x, y))
    got = {i: (int(j), int(o), int(c)) for r in vectors._twins(a, a, 0.98) for i, j, o, c in zip(r[0].tolist(), r[3], r[5], r[6])}
    hit = (m @ m.T >= 0.98) & ~np.eye(400, dtype=bool)
    want = {int(i): (int(np.flatnonzero(hit[i])[0]), int(hit[i, :i].sum()), int(hit[i, i:].sum())) for i in np.flatnonzero(hit.any(1))}
    assert got == want and len(want) >= 10
    assert sum(full) <= hit.sum() + 400 + 40
