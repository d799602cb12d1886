"""Transducers against the tokenizers library, packed files round trip, FM-index against brute force."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundwork.llm import decontaminate as D
from groundwork.llm import idfiles, queries, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n  x"), (5, "'re 're're'r 'll'l's ''s\n's"), (6, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (7, "x" * 20_000),
    (8, "ab" * 9000 + " " * 999), (9, "é漢😀́\x1c\x85\xa0 q "), (None, "null id"), (10, "same"), (10, "same"), (11, "word " * 30_000), (12, "<|startoftext|>Hello\tWorld"),
]


@pytest.fixture(scope="module")
def given(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes string")


def lib(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark, given):
    rows = given + [(i, t) for i, t in ODD if i != 10 and i is not None and i < 5 or i is None] + [(1000 + i, t) for i, t in ODD if i]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r.doc_id: r for r in tokens.token_counts(table(spark, rows), BYTE, slice_chars=5000).collect()}
    for (k, t), ids in zip(rows, lib(BYTE, [t for _, t in rows]), strict=True):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (len(ids), len((t or "").encode()), len(ids) > 512), k
    assert tokens.token_counts(table(spark, []), BYTE).count() == 0
    assert tokens.token_counts(table(spark, ODD), BYTE).count() == len(ODD)


def test_random_strings_and_small_tables_of_states():
    rng = random.Random(4)
    texts = ["".join(rng.choice("'stmdrvel ls  \n\tA9²Ⅷ!?…’é漢😀́\x1c\x85\xa0'") for _ in range(rng.randint(0, 150))) for _ in range(1500)]
    texts += ["".join(chr(rng.randrange(0x20, 0xD800)) for _ in range(50)) for _ in range(300)]
    want = [len(x) for x in lib(BYTE, texts)]
    tool = tokens.Compiled(BYTE, words=50)
    assert tool.count(texts).tolist() == want
    tool.counter.most = 20  # states are dropped again and again
    tool.known.clear()
    assert tool.count(texts).tolist() == want


def test_chunk_maps_compose():
    classes = np.random.default_rng(0).integers(0, 11, 64 * 37).astype(np.uint8)
    rows = np.ascontiguousarray(classes.reshape(-1, 64).T)
    entry = tokens.entry_states(tokens.chunk_maps(rows))
    state, want = tokens.START, []
    for i, c in enumerate(classes):
        if i % 64 == 0:
            want.append(state)
        state = tokens.AFTER[state * 16 + c]
    assert entry.tolist() == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.Compiled(WORD)


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        packed = idfiles.pack(ids, bits)
        assert packed.nbytes == 8 * bits * -(-n // 64)
        assert (idfiles.unpack(packed, bits, n) == ids).all()
    with pytest.raises(ValueError, match="bits"):
        idfiles.pack(np.array([1 << bits], np.uint64), bits)
    assert [idfiles.width(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(monkeypatch):
    monkeypatch.setattr(idfiles, "BLOCK", 128)
    lengths = np.array([0, 5, 300, 1, 128, 77])
    ids = np.random.default_rng(1).integers(0, 5000, lengths.sum()).astype(np.uint32)
    f = idfiles.IdFile(io.BytesIO(idfiles.file_bytes([4, None, 6, 7, 8, 9], lengths, ids, 13)))
    at = np.concatenate([[0], np.cumsum(lengths)])
    assert all((f.document(k) == ids[at[k] : at[k + 1]]).all() for k in range(6))
    assert f.nulls.tolist() == [False, True, False, False, False, False]
    assert all((f.ids(a, b) == ids[a:b]).all() for a, b in ((0, 511), (127, 129), (128, 256), (300, 300), (500, 511)))


def test_files_read_back(spark, given, monkeypatch):
    monkeypatch.setattr(idfiles, "FILE_IDS", 5000)
    rows = given + [(None if i is None else 5000 + i, t) for i, t in ODD]
    got = idfiles.token_files(table(spark, rows), WORD).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (i, _), ids in zip(order, lib(WORD, [t for _, t in order]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert idfiles.token_files(table(spark, []), WORD).count() == 0


# ---- decontamination ---------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        at = {}
        for n in range(1, size + 1):
            for k in range(len(w) - n + 1):
                at.setdefault(tuple(w[k : k + n]), []).append(k)
        for name, x in items:
            b = words(x)
            for k in range(max(1, len(b) - size + 1)) if b else ():
                win = tuple(b[k : k + size])
                for p in at.get(win, ()):
                    hit |= set(range(p, p + len(win)))
                    found.add(name)
        names = sorted("" if n is None else str(n) for n in found)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def test_find_matches_brute_force(spark, given, sf):
    rng = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(9001, "One, two three"), (9002, "solo"), (9003, None), (9004, " !! "), (9005, "é É é x" * 4), (9001, "another two three"), (None, "no id at all here")]
    parts = [w for _, t in items if t for w in [t]]
    docs = given + [(5000 + k, " ".join(rng.choice(parts)[rng.randint(0, 30) :] for _ in range(3))) for k in range(40)]
    docs += [(6001, "ONE two-three solo One two three one two three"), (6002, None), (6003, ""), (6004, "solo"), (6004, "solo"), (None, "no id at all here"), (6005, "solo " * 20_000)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, _words string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain(docs, items), key=repr)
    for options in ({}, {"block_bytes": 4000}):
        assert sorted((tuple(r) for r in D.report(d, b, **options).collect()), key=repr) == want
    clean = D.clean(d, b)
    assert clean.columns == d.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((r[0] for r in want if not r[5]), key=repr)
    assert D.report(d.limit(0), b).count() == 0
    assert D.report(d, b.limit(0)).where("contaminated or n_items > 0 or n_hit > 0").count() == 0


def test_short_alphabets(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(60):
        text = rng.integers(0, 4, rng.integers(1, 200)).astype(np.int64)
        assert D.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        index = D.FMIndex(text, 4, sample=5)
        for n in (1, 2, 4):
            p = rng.integers(1, 4, (10, n)).astype(np.int64)
            lo, hi = index.search(p, np.full(10, n))
            for k in range(10):
                at = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[k]).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == at


def test_spans_are_cut(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    d = spark.createDataFrame([(1, f"Before it: {item.upper()}; after it."), (2, "alpha beta"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.remove(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "Before it: ; after it.", 2: "alpha beta", 3: None}


def test_queries_give_the_contract_columns(spark, sf):
    want = {
        "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op7_packed_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op3_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    }
    for name, cols in want.items():
        d = queries.QUERIES[name](spark, sf)
        assert d.columns == cols and d.agg(F.count(F.lit(1))).first()[0] == spark.read.parquet(f"{sf}/documents.parquet").count()
