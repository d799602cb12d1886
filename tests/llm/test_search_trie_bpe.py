"""Byte-level BPE against the library, tries and ranked search against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from groundwork.llm import bpe, lexical, queries, tries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- byte-level BPE ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(RANKS, public_tokenizers.PATTERN)


def ids_of(coder, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in coder.encode(texts)]


def test_rank_queue_pops_lowest_rank_then_leftmost():
    rng, queue = random.Random(3), bpe.RankQueue(70_000)
    held = []
    for _ in range(4000):
        if held and rng.random() < 0.45:
            held.sort()
            assert queue.pop() == held.pop(0)
        else:
            held.append((rng.choice([rng.randrange(70_000), rng.randrange(50)]), rng.randrange(1000)))
            queue.push(*held[-1])
    assert [queue.pop() for _ in held] == sorted(held) and queue.pop() is None


def test_ids_equal_the_library(coder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("'stmdrvel ls  \n\tA9²Ⅷ!?…’é漢😀́\x1c\x85\xa0'") for _ in range(rng.randint(0, 150))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(800)]
    texts += ["".join(chr(c) for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) for i in range(0, 0x110000, 64)]  # every code point
    texts += ["a" * 30_001, " " * 9999 + "x", "ab" * 9000 + "c", "<|endoftext|> <|endoftext|>", ""]
    assert ids_of(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_both_ways_to_merge_agree_and_forgetting_changes_nothing(coder, library, monkeypatch):
    rng = random.Random(6)
    pieces = [bytes(rng.choice(b"aabbcdeth \xc3\xa9") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    assert [np.frombuffer(x, np.int32).tolist() for x in coder.merge_many(pieces)] == [coder.merge(p) for p in pieces]
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    texts = [" ".join(rng.choice(["so", "many", "wordsandmore", "x" * 99]) + str(rng.randrange(60)) for _ in range(30)) for _ in range(20)]
    assert [x for t in texts for x in ids_of(coder, [t])] == [library.encode_ordinary(t) for t in texts]


def test_encode_decode_over_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "same same"), (3, "same same"), (None, "null id"), (4, "é漢😀 " * 9000), (5, "x" * 100_000), (6, "word " * 50_000)]
    table = spark.createDataFrame([(i, t, "ids", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.digests(table, RANKS).collect()
    want = [(i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(table.where("false"), RANKS).count() == 0
    cut = spark.createDataFrame([(1, [10, 11]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(cut, RANKS).sort("doc_id").collect()] == [library.decode_bytes([10, 11]), b"", b""]


def test_query_equals_the_library_on_whole_documents(spark, sf, library):
    got = {r.doc_id: r for r in queries.op11_byte_bpe(spark, sf).collect()}
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(given)
    for r in given:
        ids = library.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# ---- tries -------------------------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[: d - 1]].add(v[:d])
        ends[v].append(c)
    leaves, saved = {}, {}
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[k] for k in kids[v]) or 1
        saved[v] = sum(saved[k] for k in kids[v]) + ((len(members[v]) - 1) * len(v[-1][1]) if v else 0)
    sha = lambda v: hashlib.sha256(",".join(map(str, ends[v])).encode()).hexdigest()
    return sorted((m[0], len(v), members[v[:-1]][0] if v else -1, len(m), len(kids[v]), leaves[v], saved[v], sha(v)) for v, m in members.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(rng):
    rows = []
    for c in range(0, 260):
        n = rng.choice([1, 2, 3, 5, 8, 12])
        rows += [(c, t, rng.choice(["user", "bot"]), f"{rng.choice('abc')}{'é' * rng.randrange(3)}") for t in range(n)]
    for c in range(1000, 1120):  # copies
        rows += [(c, t, "user", f"copy {t}") for t in range(7)]
    for c in (2001, 2002, 2003, 2101):  # long ones, two of them alike to the end
        rows += [(c, t, "bot", "long" if c != 2003 or t != 150 else "other") for t in range(200)]
    rows += [(2300, t, "user", str(t)) for t in range(300)]
    rows += [(7, 1, "user", "again"), (7, 1, "user", "again"), (8, None, None, None), (8, None, "user", "first"), (-150, 3, "x", "minus"), (-100, 1, "y", "base"), (-100, 2, "y", "base")]
    return rows


def table(spark, rows, parts=7):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, ends string").repartition(parts)


@pytest.mark.parametrize("shard_turns", [1, 300, 1 << 17])
def test_trie_equals_brute_force(spark, shard_turns):
    rng = random.Random(11)
    rows = conversations(rng) + [(None, 1, "user", "no conversation")]
    assert trie_rows(tries.conversation_trie(table(spark, rows), shard_turns)) == plain_trie(rows)


def test_small_tries(spark):
    assert tries.conversation_trie(table(spark, [(1, 1, "a", "b")]).where("false")).count() == 0
    turnless = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its opening is absent, its own turn lies within it
    assert trie_rows(tries.conversation_trie(table(spark, [(turnless, 1, "a", "b")]))) == plain_trie([(turnless, 1, "a", "b")])
    assert len(plain_trie([(turnless, 1, "a", "b")])) == 1


def test_hot_conversation_and_copies_are_cut(spark):
    """One conversation and one group of copies hold a third each; no partition of either sort holds much more than its share."""
    rows = [(5, t, "user", f"t{t}") for t in range(3000)] + [(c, t, "bot", f"c{t}") for c in range(100, 850) for t in range(4)] + [(c, 0, "user", str(c)) for c in range(2000, 5000)]
    df = table(spark, rows, 16)
    pieces = tries._pieces(df)
    assert pieces.groupBy("conv_id").agg(F.sum(F.octet_length("turns") / 20).cast("int").alias("n")).where("conv_id = 5").first().n == 3000
    assert trie_rows(tries.conversation_trie(df, 1000)) == plain_trie(rows)


def test_double_array_holds_exactly_its_words():
    rng = random.Random(8)
    for _ in range(60):
        words = sorted({tuple(rng.randrange(rng.choice([3, 40])) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 120))})
        trie = tries.DoubleArray(np.array([c for w in words for c in w]), np.array([len(w) for w in words]))
        prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
        assert int((trie.check >= 0).sum()) == len(prefixes)
        for w in [*prefixes, *(p + (rng.randrange(45),) for p in prefixes)]:
            slot = np.zeros(1, np.int64)
            for c in w:
                slot = trie.step(slot, np.array([c])) if slot[0] >= 0 else slot
            assert (slot[0] >= 0) == (w in prefixes), w


# ---- ranked search -----------------------------------------------------------------------------

def plain_search(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    counted = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted, out = defaultdict(set), []
    for i, t in items:
        wanted[i] |= set(terms(t))
    for item, ts in wanted.items():
        scored = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [3, 1024])
def test_search_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(lexical, "COLUMNS", tile)
    monkeypatch.setattr(lexical, "DOCS", tile * 5)
    rng = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "delta7", "é", "ÉX", "漢字", "x1", "the", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    docs += [(200 + i, "the of beta") for i in range(60)] + [(None, "beta é"), (500, None), (501, ""), (502, "--- !"), (503, "the of beta"), (503, "the of beta"), (504, "beta_of-the\nbeta " * 20_000)]
    items = [(1, "Beta the"), (2, "é漢字 é"), (3, "nowhere"), (4, None), (5, ""), (None, "gamma delta7"), (1, "X1"), (6, "the of beta"), (7, " ".join(words))]
    d = spark.createDataFrame([(i, t, 1.0, 2) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(5)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical.search(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items)
    assert sorted(map(tuple, lexical.search(d, q, k=3, block_items=2).collect()), key=str) == plain_search(docs, items, 3)
    assert lexical.search(d.where("false"), q).count() == 0 and lexical.search(d, q.where("false")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), q).count() == 0


def test_best_keeps_ties_until_ids_decide():
    best = lexical.Best(1, 2)
    for docs in ([9, 8, 7], [6, 30], [2]):
        best.add(np.full((len(docs), 1), 5), np.array(docs))
    assert best.rows[2].tolist() == [2, 6]
