"""The stored lexical index against a plain BM25 over what is live and visible."""

import math
import random
import re
import shutil
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.operators import guards, retrieval, search

SCHEMA = "tenant string, passage_id string, text string, acl array<string>"


def plain(passages, questions, k):
    """passages: live (tenant, id, text, acl) rows."""
    out = []
    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    for q, tenant, text, accessible in questions:
        seen = [(i, Counter(w := tok(t)), len(w)) for ten, i, t, acl in passages if ten == tenant and set(acl or []) & set(accessible)]
        if not seen:
            continue
        avgdl = sum(n for *_, n in seen) / len(seen)
        df = Counter(t for _, c, _ in seen for t in c)
        scored = []
        for i, c, n in seen:
            s = sum(math.log(1 + (len(seen) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / avgdl)) for t in tok(text) if c[t])
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.passage_id, r.score, r["rank"]) for r in df.collect())


def same(got, want):
    assert [(a[0], a[1], a[3]) for a in got] == [(b[0], b[1], b[3]) for b in want]
    assert np.allclose([a[2] for a in got], [b[2] for b in want], atol=2e-6)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 20, 60])]) for _ in range(rng.randint(0, 40)))
    first = [(t, f"{t}-{k}", text(), [a] if a else None) for t in ("t1", "t2") for k in range(150) for a in [rng.choice(["public", "restricted", "other", None])]]
    first += [("t1", f"copy-{k}", "w1 w2 w2", ["public", "x"]) for k in range(80)] + [("t1", "none", None, ["public"])]
    questions = [(f"q{k}", ("t1", "t2")[k % 2], text(), ["public"] + ["restricted"] * (k % 3 == 0)) for k in range(30)]
    questions += [("nothing", "t1", "zzz", ["public"]), ("null", "t1", None, ["public"]), ("stranger", None, "w1", ["public"]), ("closed", "t1", "w1", ["nobody"]), ("copies", "t1", "w2 w1", ["public"])]
    return first, questions


def test_segments_follow_the_store(spark, made, tmp_path):
    first, asked = made
    path = str(tmp_path / "index")
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    qs = spark.createDataFrame(asked, "query_id string, tenant string, text string, accessible array<string>")
    assert search.last_segment(spark, path) == -1
    search.add_segment(df(first), path, shard_passages=40)
    same(rows_of(search.search(spark, path, qs, 7)), plain(first, asked, 7))
    gone = [r for r in first if r[1].endswith(("3", "7"))]
    new = [("t1", f"new-{k}", f"w{k} w1 w2 again", ["public"]) for k in range(20)]
    search.add_segment(df(new), path, gone=df(gone))
    live = [r for r in first if r not in gone] + new
    same(rows_of(search.search(spark, path, qs, 7)), plain(live, asked, 7))
    search.add_segment(df(gone[:5]), path)  # they come back, as after a rollback
    live += gone[:5]
    same(rows_of(search.search(spark, path, qs, 7)), plain(live, asked, 7))
    assert search.last_segment(spark, path) == 2
    search.merge_segments(spark, path, str(tmp_path / "merged"), shard_passages=64)
    same(rows_of(search.search(spark, str(tmp_path / "merged"), qs, 7)), plain(live, asked, 7))
    with pytest.raises(ValueError):
        search.merge_segments(spark, path, str(tmp_path / "merged"))
    terms = {r.term: r.df for r in search.term_counts(spark, path, "t1", ["public"]).collect()}
    seen = [set(re.findall("[a-z0-9]+", r[2] or "")) for r in live if r[0] == "t1" and "public" in (r[3] or [])]
    assert terms == dict(Counter(t for s in seen for t in s))


def test_half_written_segment_is_not_seen(spark, made, tmp_path):
    first, asked = made
    path = str(tmp_path / "index")
    qs = spark.createDataFrame(asked, "query_id string, tenant string, text string, accessible array<string>")
    search.add_segment(spark.createDataFrame(first[:100], SCHEMA), path)
    before = rows_of(search.search(spark, path, qs, 5))
    for name in ("passages", "postings", "terms", "gone"):  # all but the table that completes a segment
        shutil.copytree(f"{path}/{name}/segment=0", f"{path}/{name}/segment=1")
    assert rows_of(search.search(spark, path, qs, 5)) == before
    search.add_segment(spark.createDataFrame(first[100:], SCHEMA), path)
    same(rows_of(search.search(spark, path, qs, 5)), plain(first, asked, 5))


def test_question_blocks_and_the_scan_agree_with_the_index(spark, made, tmp_path, monkeypatch):
    first, asked = made
    path = str(tmp_path / "index")
    search.add_segment(spark.createDataFrame(first, SCHEMA), path)
    qs = spark.createDataFrame(asked, "query_id string, tenant string, text string, accessible array<string>")
    one = rows_of(search.search(spark, path, qs, 5))
    monkeypatch.setattr(search, "QUESTIONS", 4)
    assert rows_of(search.search(spark, path, qs, 5)) == one
    none = spark.createDataFrame([], qs.schema)
    assert search.search(spark, path, none, 5).count() == 0
    numbered = spark.createDataFrame([(k, *r[2:]) for k, r in enumerate(first) if r[0] == "t1"], "passage_id long, text string, acl array<string>")
    mine = qs.where("tenant = 't1' and text is not null").withColumn("query_id", F.xxhash64("query_id"))
    search.add_segment(numbered.withColumn("tenant", F.lit("t1")), str(tmp_path / "numbered"))
    for way in ("matrix", "pruned"):  # ways that read the texts
        same(rows_of(search.search(spark, str(tmp_path / "numbered"), mine, 5)), rows_of(retrieval.bm25_topk(mine, numbered, 5, way=way)))


def test_common_terms_are_looked_up_for_few_passages_only():
    rng = np.random.default_rng(1)
    n = 5000
    length = rng.integers(20, 60, n).astype(float)
    pick = lambda share: np.flatnonzero(rng.random(n) < share)
    terms = []
    for weight, share in [(9.0, 0.01), (8.0, 0.01), (7.0, 0.02), (6.5, 0.02)] + [(0.3, 0.9)] * 6:
        at = pick(share)
        tf = np.ones(len(at))
        terms.append((weight, weight * search._gain(1, length.min(), 40.0), at, tf))
    want = np.zeros(n)
    for w, _, at, tf in terms:
        want[at] += w * search._gain(tf, length[at], 40.0)
    live = rng.random(n) < 0.9
    at, score, read = search.best_of_shard(terms, length, live, 40.0, 10)
    want[~live] = 0
    best = np.lexsort((np.arange(n), -want))[:10]
    assert set(best) <= set(at.tolist()) and np.allclose(score, want[at])
    assert read < 0.2 * sum(len(t[2]) for t in terms)


def test_tenant_is_required(spark):
    q = spark.createDataFrame([("q", "t1", "x", ["public"])], "query_id string, tenant string, text string, accessible array<string>")
    with pytest.raises(ValueError):
        guards.tenant_guard(q, "")


def test_passages_are_not_dealt_by_access_list(spark):
    """A join by access list would put all passages into as many tasks as there are lists."""
    rows = [("t1", "public", i, 1, "word", None) for i in range(600)]
    p = spark.createDataFrame(rows, "tenant string, acl_key string, passage_id long, dl long, terms string, tfs array<int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = search._dealt(p, 8192)
        plan = d._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert d.select("part").distinct().count() == 3 and d.count() == 600


def test_merging_and_counting_explode_no_postings(spark, tmp_path, monkeypatch):
    """Shards go through revert, the counts add up whole lists; passages without terms and those taken away are right."""
    texts = ["a b a", "b", None, "...", "c a"] * 3
    p = spark.createDataFrame([("t1", str(i), t, ["public"]) for i, t in enumerate(texts)], SCHEMA)
    more = spark.createDataFrame([("t1", "x", "c c", ["public"])], SCHEMA)
    search.add_segment(p, f"{tmp_path}/i", shard_passages=4)
    search.add_segment(more, f"{tmp_path}/i", gone=p.where("passage_id in ('0', '1', '2')"), shard_passages=4)
    counts = lambda path: sorted(tuple(r) for r in search.term_counts(spark, path, "t1", ["public"]).collect())
    want = [("a", 5, 7, 2), ("b", 4, 4, 1), ("c", 4, 5, 2)]
    assert counts(f"{tmp_path}/i") == want
    monkeypatch.setattr(search, "_postings", None)
    search.merge_segments(spark, f"{tmp_path}/i", f"{tmp_path}/m", shard_passages=4)
    assert counts(f"{tmp_path}/m") == want
    q = spark.createDataFrame([(1, "t1", "c", ["public"])], "query_id int, tenant string, text string, accessible array<string>")
    found = search.search(spark, f"{tmp_path}/m", q, 9)
    assert rows_of(found) == rows_of(search.search(spark, f"{tmp_path}/i", q, 9)) and found.count() == 4
    n = spark.read.parquet(f"{tmp_path}/m/passages").where("dl = 0").count()
    assert n == 5


def test_a_shard_is_scored_for_all_questions_of_a_block_at_once():
    """Brute force gives the same for two mean lengths and dead passages; worth of a posting is computed per mean length, not per question."""
    rng = np.random.default_rng(7)
    n, terms, k = 300, 40, 3
    length, live = rng.integers(5, 60, n).astype(np.float64), rng.random(n) > 0.1
    count = rng.poisson(rng.uniform(0.01, 1.5, terms)[:, None], (terms, n))
    count[:, 0] = 1  # no term without a posting
    asks = [(f"q{i}", 20.0 + 10 * (i % 2), {int(t): float(rng.uniform(0.1, 9)) for t in rng.choice(terms, 6, replace=False)}) for i in range(50)]
    at = [np.flatnonzero(c) for c in count]
    qs = [[{"query_id": q, "w": ws[t], "avgdl": m} for q, m, ws in asks if t in ws] for t in range(terms)]
    kind = pa.list_(pa.struct([("query_id", pa.string()), ("w", pa.float64()), ("avgdl", pa.float64())]))
    rows = pa.table({
        "ats": pa.array([a.tolist() for a in at], pa.list_(pa.int32())), "tfs": pa.array([count[t][a].tolist() for t, a in enumerate(at)], pa.list_(pa.int32())),
        "max_tf": pa.array(count.max(1), pa.int32()), "min_dl": pa.array([int(length[a].min()) for a in at], pa.int64()), "qs": pa.array(qs, kind),
    })
    calls, gain = [], search._gain
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "_gain", lambda *x: calls.append(np.size(x[0])) or gain(*x))
        ids, found, scores = search.best_of_questions(rows, length, live, k)
    assert calls == [sum(map(len, at)), terms] * 2
    got = {}
    for q, p, x in zip(ids.to_pylist(), found.tolist(), scores.tolist(), strict=True):
        got.setdefault(q, []).append((-round(x, 6), p))
    for q, mean, ws in asks:
        want = sum(w * np.where(count[t] > 0, gain(count[t], length, mean), 0.0) for t, w in ws.items()) * live
        best = sorted((-round(x, 6), p) for p, x in enumerate(want.tolist()) if x > 0)[:k]
        assert [p for _, p in sorted(got[q])[:k]] == [p for _, p in best]
    assert search.best_of_questions(rows.slice(0, 0), length, live, k)[0].to_pylist() == []


def test_shards_are_filled_in_place_and_merged_without_lines(spark, made, tmp_path, monkeypatch):
    """Passages are not shuffled into shards, however few a task holds at a time, and one merge of all is the same index."""
    first, asked = made
    monkeypatch.setattr(search, "PIECE", 1)
    monkeypatch.setattr(search, "HELD", 4000)
    monkeypatch.setattr(search, "_dealt", None)
    path, one = str(tmp_path / "i"), str(tmp_path / "m")
    qs = spark.createDataFrame(asked, "query_id string, tenant string, text string, accessible array<string>")
    search.add_segment(spark.createDataFrame(first, SCHEMA), path, shard_passages=30)
    same(rows_of(search.search(spark, path, qs, 7)), plain(first, asked, 7))
    gone = [r for r in first if r[1].endswith(("2", "9"))]
    search.add_segment(spark.createDataFrame([("t1", "new", "w1 w1 É w2", ["public"])], SCHEMA), path, gone=spark.createDataFrame(gone, SCHEMA), shard_passages=30)
    live = [r for r in first if r not in gone] + [("t1", "new", "w1 w1 É w2", ["public"])]
    search.merge_segments(spark, path, one, shard_passages=100)
    counts = lambda p: sorted(tuple(r) for r in search.term_counts(spark, p, "t1", ["public"]).collect())
    assert counts(path) == counts(one)
    sizes = [r["count"] for r in spark.read.parquet(f"{one}/passages").groupBy("tenant", "acl_key", "part").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == len(live)
    same(rows_of(search.search(spark, one, qs, 7)), plain(live, asked, 7))


def test_lists_are_packed_in_few_bytes():
    """Each list takes the bytes that its largest number needs; terms are runs of letters and digits of ASCII."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 50, 300)
    top = rng.choice([2, 255, 256, 65535, 65536, 1 << 30], 300)
    x = np.concatenate([np.r_[t, rng.integers(0, t + 1, n - 1)] for t, n in zip(top, sizes)]).astype(np.int64)
    packed = search.narrow(x, np.cumsum(sizes) - sizes)
    assert (search.widen(packed, sizes) == x).all()
    assert (search.widen(packed.slice(100, 50), sizes[100:150]) == x[sizes[:100].sum() : sizes[:150].sum()]).all()
    assert [len(b) // n for b, n in zip(packed.to_pylist(), sizes.tolist())] == [1 if t < 256 else 2 if t < 65536 else 4 for t in top]
    lines = ["", None, "  a1-b é z", "a1", "...", "x\ny "]
    for at in (0, 2):
        n, words = search.split_terms(pa.array(lines).slice(at))
        want = [re.findall("[a-z0-9]+", t or "") for t in lines[at:]]
        assert n.tolist() == [len(w) for w in want] and words.to_pylist() == sum(want, [])


def test_shards_that_live_are_packed_together():
    row = lambda segment, part, n, dead, tenant="t": {"segment": segment, "tenant": tenant, "acl_key": "a", "part": part, "n": n, "dead": dead}
    got = search.pack([row(0, 0, 90, 0), row(0, 1, 40, 5), row(1, 0, 30, 0), row(1, 1, 7, 7), row(0, 2, 120, 1), row(0, 0, 5, 0, None)], 100)
    assert sorted(x[:1] + x[2:] for x in got if x[1]) == [(0, "a", 0, 1, True), (0, "a", 1, 0, False), (0, "a", 2, 2, False), (1, "a", 0, 0, False)]
    assert [x for x in got if not x[1]] == [(0, None, "a", 0, 0, True)]


def test_questions_are_not_copied_to_the_postings(spark, made, tmp_path, monkeypatch):
    """Blocks of questions and shards are written once and meet as they are; a task keeps the best over its shards."""
    first, asked = made
    path = str(tmp_path / "i")
    search.add_segment(spark.createDataFrame(first, SCHEMA), path, shard_passages=25)
    asked = asked + [asked[0]]  # asked twice under one id: its terms count twice
    qs = spark.createDataFrame(asked, "query_id string, tenant string, text string, accessible array<string>")
    monkeypatch.setattr(search, "QUESTIONS", 10)
    monkeypatch.setattr(search, "TOGETHER", 40)
    out = search.search(spark, path, qs, 3)
    assert "CartesianProduct" in out._jdf.queryExecution().sparkPlan().toString()
    once = [(q, t, f"{x} {x}" if q == asked[0][0] else x, a) for q, t, x, a in asked[:-1]]
    same(rows_of(out), plain(first, once, 3))


def test_a_floor_spares_postings_and_scores_are_handed_back_clean():
    """What can't reach the floor is left out; the passages over it and their scores are those of the whole."""
    rng = np.random.default_rng(3)
    n, score = 4000, np.zeros(4000)
    terms = [(w, w * 2.0, np.flatnonzero(rng.random(n) < share), None) for w, share in [(9.0, 0.01), (5.0, 0.02)] + [(1.0, 0.5)] * 6]
    terms = [(w, b, at, rng.uniform(0.5, 2.0, len(at))) for w, b, at, _ in terms]
    want = np.zeros(n)
    for w, _, at, gain in terms:
        want[at] += w * gain
    for floor in (0.0, 15.0, 25.0, 99.0):
        at, sums, read = search._best(terms, score, None, 5, floor)
        assert not score.any() and np.allclose(sums, want[at])
        best = [i for i in np.lexsort((np.arange(n), -np.round(want, 6)))[:5].tolist() if want[i] >= floor]
        assert set(best) <= set(at.tolist())
    assert read == 0
