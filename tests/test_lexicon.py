"""Lexicon automaton against plain substring search."""

import random

import numpy as np

from groundwork.functions import automaton
from groundwork.operators import lexicon


def searched(terms, texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    rows, found = automaton.find(automaton.build([t.encode() for t in terms]), np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(r) for r in raw], ends)
    return list(zip(rows.tolist(), [terms[i] for i in found]))


def plain(terms, texts):
    return sorted(((i, t) for i, x in enumerate(texts) for t in terms if t in x), key=lambda p: (p[0], terms.index(p[1])))


def test_find_equals_plain_search():
    rng = random.Random(5)
    for alphabet, longest in (("ab", 6), ("abcé漢", 4), ("a", 9)):
        for _ in range(20):
            terms = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, longest))) for _ in range(rng.randint(1, 12))})
            texts = ["".join(rng.choices(alphabet + "x", k=rng.choice([0, 1, 5, 40, 900]))) for _ in range(8)]
            assert searched(terms, texts) == plain(terms, texts)


def test_terms_across_pieces_and_long_terms():
    term, long = "needle", "l" * 700
    text = "".join("." * 509 + term for _ in range(9)) + "." * 5000 + long
    assert searched([term, long], [text, "", "needl", text[1:-1]]) == [(0, term), (0, long), (3, term)]


def test_many_terms_with_one_prefix():
    terms = [f"prefix{i:05d}" for i in range(5000)]
    texts = [f"a {terms[i]} b {terms[-1 - i]}" for i in range(0, 5000, 7)]
    want = [(k, t) for k, i in enumerate(range(0, 5000, 7)) for t in sorted({terms[i], terms[-1 - i]})]
    assert searched(terms, texts) == want


def test_all_byte_values():
    assert searched(["é", "漢", "\x00", "ÿ"], ["é\x00", "Ã©", "x漢ÿ"]) == [(0, "é"), (0, "\x00"), (2, "漢"), (2, "ÿ")]


def test_lexicon_join_in_one_and_many_blocks(spark, monkeypatch):
    rng = random.Random(9)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choices("abcd", k=rng.choice([0, 3, 30]))) for _ in range(50)]
    n = spark.createDataFrame([(t, t.upper()) for t in terms] + [(terms[0], "again"), (None, "null"), ("", "empty")], "term string, name string")
    h = spark.createDataFrame([(i, t, [t]) for i, t in enumerate(texts)] + [(50, None, None), (0, texts[0], [texts[0]])], "id long, text string, extra array<string>")
    want = sorted((name, i) for t, name in [*((t, t.upper()) for t in terms), (terms[0], "again")] for i, x in [*enumerate(texts), (0, texts[0])] if t in x)
    for block in (lexicon.BLOCK, 40):
        monkeypatch.setattr(lexicon, "BLOCK", block)
        got = lexicon.lexicon_join(n, "term", h, "text")
        assert got.columns == ["term", "name", "id", "extra"]
        assert sorted((r["name"], r["id"]) for r in got.collect()) == want


def test_lexicon_join_of_empty_tables(spark):
    n, h = spark.createDataFrame([("a",)], "term string"), spark.createDataFrame([(1, "a")], "id long, text string")
    for x, y in ((n.where("false"), h), (n, h.where("false"))):
        got = lexicon.lexicon_join(x, "term", y, "text")
        assert got.columns == ["term", "id"] and got.count() == 0
    assert lexicon.lexicon_join(n, "term", h, "text").collect() == [("a", 1)]


def test_texts_are_not_shuffled(spark):
    n, h = spark.createDataFrame([("a",)], "term string"), spark.createDataFrame([(1, "a")], "id long, text string")
    plan = lexicon.lexicon_join(n, "term", h, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
