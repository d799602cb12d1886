"""Language profiles, the classifier and near duplicates against held-out rows and brute force; the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundwork.llm import classifier, dedup, languages, mixing, queries

ODD = [
    (1, None, None, "a"), (2, "", "en", None), (3, " \n", "en", "a"), (4, "12 !!", "en", "a"), (5, "a", "en", "a"), (6, "é", "fr", "b"),
    (None, "no id here at all my friend", "en", "b"), (7, "same words are here for all of us", "en", "b"), (7, "same words are here for all of us", "en", "b"), (8, "漢字 かな", "ja", "c"),
    (9, "long " * 30_000, "en", "b"), (10, "x" * 100_000, "de", "b"),
]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# ---- languages ---------------------------------------------------------------------------------

def test_profiles_bind_and_bundle():
    runs, at, owner = languages.runs_of(["Ab c", "", "9!", "ÄB"])
    got = ["".join(chr(x) if x else "_" for x in runs[k]) for k in at]
    assert got == ["_ab", "ab_", "_c_", "_äb", "äb_"] and owner.tolist() == [0, 0, 0, 3, 3]
    a, b, c = (languages.letter_vectors(np.array([ord(x)]))[0] for x in "abc")
    assert (languages.bind(np.array([[97, 98, 99]]))[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    assert abs(float(a.astype(int) @ b)) < 200 and set(np.unique(a)) == {-1, 1}
    wide = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 3000))  # too many letters for a dense table
    assert len(languages.runs_of([wide])[0]) == 3000
    assert (languages.bundle([wide], np.array([0]), 1) == languages.bind(languages.runs_of([wide])[0]).sum(axis=0)).all()


def test_languages_of_held_out_rows(spark, docs_of):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = languages.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(right) > 100 and np.mean(right) > 0.95
    odd = languages.identify(docs_of(ODD * 3)).collect()
    assert len(odd) == 3 * len(ODD)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 4)) for r in odd)
    assert languages.identify(docs_of([])).count() == 0
    assert {r.lang_pred for r in languages.identify(docs_of([(1, "text", None, "a")])).collect()} == {"und"}


# ---- classifier --------------------------------------------------------------------------------

def plain_bag(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    return len(words) + sum(a == b for a, b in zip(words, words[1:], strict=False)) + sum(max(0, len(data) - n + 1) for n in classifier.GRAMS)


def test_bags_hold_every_feature():
    import pyarrow as pa

    texts = [r[1] for r in ODD] + ["a a b b b c", "ab", "abc", None, "", "abcd a"]
    found = [b for _, _, data, off in classifier.text_slices(pa.array(texts), 30) for b in classifier.bags(data, off)]
    assert [int(n.sum()) for _, n in found] == [plain_bag(t) for t in texts]
    whole = [b for _, _, data, off in classifier.text_slices(pa.array(texts)) for b in classifier.bags(data, off)]
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(found, whole, strict=True))


def test_quality_of_held_out_rows(spark, docs_of):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = classifier.quality(d, labels).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = [r.score for r in test if r.quality == 1], [r.score for r in test if r.quality == 0]
    auc = np.mean([[(x > y) + 0.5 * (x == y) for y in bad] for x in good])
    assert len(bad) > 5 and auc > 0.97


def test_classifier_odd_tables(spark, docs_of):
    d = docs_of(ODD).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.quality(d, none).collect()} == {0.5}
    odd = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (7, 0, 0), (99, 1, 1), (9, 5, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality(d, odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert classifier.quality(d.limit(0), odd).count() == 0
    assert len(classifier.training_sample(docs_of([(i, "word " * 50, "en", "a") for i in range(50)]), spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int"), rows=9)) == 9


# ---- near duplicates ---------------------------------------------------------------------------

def plain_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None:
            sets[i].add(plain_sets(t))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_rows(seed, n, words=60):
    """Chains and stars of edited texts, copies, and texts that share long passages only."""
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(4000)]
    rows, base = [], [rng.choice(vocab) for _ in range(words)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:  # drifts away from the texts before
            src = list(rng.choice([base, rows[-1][1].split() if rows and rows[-1][1] else base]))
            for _ in range(rng.randint(0, 4)):
                src[rng.randrange(len(src))] = rng.choice(vocab)
            rows.append((i, " ".join(src)))
        elif kind < 0.6 and rows:
            rows.append((i, (rng.choice(rows)[1] or "").upper().replace(" ", "\n")))
        else:
            rows.append((i, passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 7)])
def test_components_match_brute_force(spark, docs_of, monkeypatch, seed, block):
    monkeypatch.setattr(dedup, "BLOCK", block)  # small blocks take every step that large clusters take
    rows = near_rows(seed, 260) + [(1000 + k, r[1]) for k, r in enumerate(ODD)] + [(7, "second text under one id entirely"), (2000, "second TEXT under one id entirely")]
    got = dedup.components(docs_of([(i, t, "en", "a") for i, t in rows])).collect()
    want = plain_components(rows)
    assert len(got) == len(rows) and len(set(want.values())) < len(want) - 20
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(plain_sets(t))) for i, t in rows)


def test_dedup_odd_tables(spark, docs_of):
    d = docs_of([*ODD, (11, "no id here AT all my friend", "en", "b")]).withColumn("component_id", F.lit("mine"))
    got = dedup.components(d).collect()
    assert len(got) == len(ODD) + 1
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(11, False)}
    kept = dedup.keep(d)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 1 for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None)})
    assert dedup.components(docs_of([])).count() == 0 and dedup.keep(docs_of([])).count() == 0


def test_pruning_bounds():
    need = dedup.fewest_matches()
    assert len(need) == 4 and all(a < b for a, b in zip(need, need[1:], strict=False)) and need[-1] < 0.75 * 128
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(3000):  # pairs exactly at the bound
        match = rng.random(128) < 0.75 + 0.25 / 256
        lost += any(match[: 32 * (k + 1)].sum() < n for k, n in enumerate(need))
    assert lost == 0


# ---- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stages_match_brute_force(spark, sf, docs_of):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, cols = docs, docs.columns
    after = {}
    for name, fn in corpus_pipeline.STAGES:
        now = fn(spark, now, sf)
        after[name] = now
        if name != "shards":
            assert now.columns == cols
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in after.items()}
    rows = {r.doc_id: r for r in docs.collect()}

    from .test_plain_filters import plain_figures, plain_kept, plain_targets
    from .test_tokens_and_files import plain

    base_ok = {i for i, r in rows.items() if (f := plain_figures(r.text))[0] >= 20 and 100 * f[4] <= 30 * f[0]}
    one = set(ids["quality_rules"])
    assert one == plain_kept([(r.doc_id, r.text, r.lang, r.source) for r in rows.values()])
    assert one <= base_ok and len(one) > 0.8 * len(base_ok)
    comp = plain_components([(i, rows[i].text) for i in one])
    two = {i for i in one if comp[i] == i}
    assert set(ids["near_duplicates"]) == two
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    three = {r[0] for r in plain([(i, rows[i].text) for i in two], items) if not r[5]}
    assert set(ids["decontamination"]) == three
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in three}
    per = defaultdict(int)
    for i in three:
        per[rows[i].source] += size[i]
    want, taken = plain_targets(per), defaultdict(int)
    for i, n in ids["mixture"].items():
        taken[rows[i].source] += n * size[i]
        assert i in three and n <= 3
    assert all(abs(taken[s] - want[s]) <= max(size[i] for i in three if rows[i].source == s) for s in per)
    assert ids["shards"] == ids["mixture"]
    final = corpus_pipeline.run(spark, sf)
    assert final.columns == after["shards"].columns and Counter(r.doc_id for r in final.collect()) == ids["shards"]


def test_mixture_repeats_rows(spark, docs_of):
    rows = [(i, "w " * (i % 9 + 1), "en", "a" if i < 10 else "b") for i in range(60)]
    d = docs_of(rows).withColumn("size", F.lit("mine")).withColumn("times", F.lit("mine"))
    got = mixing.repeat(d)
    assert got.columns == d.columns
    times = {r.doc_id: r.times for r in mixing.mix(d).collect()}
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for i, n in times.items() if n})


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
