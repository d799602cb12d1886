"""Benchmark decontamination with an FM-index per shard of the corpus.

Benchmark items are cut into windows of ten words. Only words of the benchmark can take part in an
occurrence, so a shard (a bounded run of documents in a task) is indexed over the runs of benchmark
words that are long enough for a window; every other word is a separator. The index is a suffix array
cut down to samples, the Burrows-Wheeler text in a wavelet matrix, and the counts of smaller
symbols. All windows are searched backwards at once; occurrences are located by walking to
the next sampled suffix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Bytes of benchmark text searched at once; a larger benchmark takes several passes over the corpus.
BLOCK_BYTES = 16 << 20
#: Bytes of document text in one index.
SHARD_BYTES = 16 << 20
SAMPLE = 8
# A-Z become a-z, the other letters, digits and all bytes above 127 stay, the rest becomes a blank.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


# ---- the index ---------------------------------------------------------------------------------

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    head = np.ones(n, bool)
    head[1:] = text[order][1:] != text[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if len(open_) == 0:
            return order
        at = order[open_]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        first = rank[at]
        again = np.lexsort((after, first))
        at, after, first = at[again], after[again], first[again]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        head[open_] |= new
        rank[at] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class WaveletMatrix:
    """Rank of a symbol in any prefix of a text, one bit plane per symbol bit."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.bits = max(1, (symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            plane = (text >> b) & 1
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(plane, out=ones[1:])
            self.ones.append(ones)
            text = np.concatenate([text[plane == 0], text[plane == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the first ``upto`` places."""
        lo, hi = np.zeros_like(upto), upto
        for ones, b in zip(self.ones, reversed(range(self.bits)), strict=True):
            one = (symbol >> b) & 1 == 1
            zeros = len(ones) - 1 - ones[-1]
            lo, hi = (np.where(one, zeros + ones[x], x - ones[x]) for x in (lo, hi))
        return (hi - lo).astype(np.int64)


class FMIndex:
    """Backward search over a text of symbols from 0 (the separator) to ``symbols`` - 1.

    Inside, symbols are one higher and a single 0 ends the text, so that steps to the left are exact.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE) -> None:
        text, symbols = np.append(text + 1, 0), symbols + 1
        sa = suffix_array(text)
        bwt = text[sa - 1]  # before the first suffix stands the end
        self.n = len(text)
        self.bwt = bwt.astype(np.int32)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, symbols)
        sampled = sa % sample == 0
        self.marked = sampled
        self.mark_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that start with each pattern; patterns end at the right of their row."""
        width = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (hi > lo))
            if len(live) == 0:
                break
            c = patterns[live, width - k] + 1
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps to the left until a sampled suffix."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.marked[at]
            out[open_[done]] = self.samples[self.mark_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            c = self.bwt[at]
            at = self.less[c] + self.tree.rank(c, at)
            steps += 1
        return out


# ---- the benchmark -----------------------------------------------------------------------------

@dataclass
class Queries:
    """Distinct windows of a block of items, as symbols, and the items that hold each."""

    symbol: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # items of window k: items[first[k] : first[k + 1]]
    items: np.ndarray
    names: list[str]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def windows_of(items: Sequence[tuple[str, str | None]], size: int = WINDOW) -> Queries:
    """Every run of ``size`` words of an item; an item of fewer words, but some, is one window."""
    symbol: dict[bytes, int] = {}
    held: dict[tuple[int, ...], set[int]] = {}
    for k, (_, text) in enumerate(items):
        ids = [symbol.setdefault(w, len(symbol) + 1) for w in words_of(text)]
        if ids:
            for i in range(max(1, len(ids) - size + 1)):
                held.setdefault(tuple(ids[i : i + size]), set()).add(k)
    patterns = np.zeros((len(held), size), np.int64)
    lengths = np.array([len(w) for w in held], np.int64)
    for k, w in enumerate(held):
        patterns[k, size - len(w) :] = w
    return Queries(symbol, patterns, lengths, np.cumsum([0, *(len(x) for x in held.values())]), np.array([i for x in held.values() for i in sorted(x)], np.int64), [i for i, _ in items])


def search_shard(texts: Sequence[str | None], q: Queries) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per text: number of words, merged spans of hit words (rows of start, end), items found."""
    n_words = np.zeros(len(texts), np.int64)
    chunks: list[np.ndarray] = []
    get = q.symbol.get
    for i, t in enumerate(texts):
        w = words_of(t)
        n_words[i] = len(w)
        chunks.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
        chunks.append(np.zeros(1, np.int64))  # texts do not run into each other
    none = np.zeros((0, 2), np.int64)
    spans, found = [none] * len(texts), [[] for _ in texts]
    flat = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
    if len(q.lengths) == 0 or not flat.any():
        return n_words, spans, found
    # keep runs of benchmark words that a window fits into, and one separator after each
    known = flat > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    fits = end - begin >= q.shortest
    begin, end = begin[fits], end[fits]
    if len(begin) == 0:
        return n_words, spans, found
    lengths = end - begin + 1
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    text = flat[where]
    text[np.cumsum(lengths) - 1] = 0
    index = FMIndex(text, len(q.symbol) + 1)
    lo, hi = index.search(q.patterns, q.lengths)
    hits = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(hits)), hits)
    if len(which) == 0:
        return n_words, spans, found
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
    at = where[index.locate(rows)]
    first_word = np.concatenate([[0], np.cumsum(n_words + 1)])
    doc = np.searchsorted(first_word, at, side="right") - 1
    # spans: the union of all occurrences, from a running sum over starts and ends
    change = np.zeros(len(flat) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + q.lengths[which], -1)
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(np.diff(covered.astype(np.int8)))
    s, e = edges[::2], edges[1::2]
    for d in np.unique(doc):
        a, b = np.searchsorted(s, [first_word[d], first_word[d + 1]])
        spans[d] = np.stack([s[a:b], e[a:b]], axis=1) - first_word[d]
    pair = np.unique(doc * (len(q.lengths) + 1) + which)
    for d, w in zip(*np.divmod(pair, len(q.lengths) + 1), strict=True):
        found[d].extend(q.items[q.first[w] : q.first[w + 1]].tolist())
    return n_words, spans, [sorted({q.names[k] for k in x}) for x in found]


_FOUND = "_words long, _spans array<struct<start:int,end:int>>, _items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _union(old: list[dict], new: np.ndarray) -> list[dict]:
    """Spans of earlier passes and new ones, merged where they touch."""
    out: list[list[int]] = []
    for a, b in sorted([(s["start"], s["end"]) for s in old] + [(int(a), int(b)) for a, b in new]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _pass(docs: DataFrame, items: list[tuple[str, str | None]]) -> DataFrame:
    """``docs`` with what one block of the benchmark adds to _words, _spans and _items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text and one item
    names = docs.columns[:-3]

    def shard(rows: list[pa.RecordBatch], q: Queries) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        n, spans, found = search_shard(t.column("_text").to_pylist(), q)
        spans = [_union(x, y) if len(y) else x for x, y in zip(t.column("_spans").to_pylist(), spans, strict=True)]
        found = [sorted({*x, *y}) if y else x for x, y in zip(t.column("_items").to_pylist(), found, strict=True)]
        cols = [*(t.column(c) for c in names), pa.array(n), pa.array(spans, _SPAN), pa.array(found, pa.list_(pa.string()))]
        yield from pa.table(cols, names=[*names, "_words", "_spans", "_items"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = windows_of(shared.value)
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            step = max(1, int(b.num_rows * SHARD_BYTES // max(b.nbytes, 1)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                held.append(part)
                size += part.nbytes
                if size >= SHARD_BYTES:
                    yield from shard(held, q)
                    held, size = [], 0
        if held:
            yield from shard(held, q)

    return docs.mapInArrow(run, docs.schema)


def annotate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` as _0, _1, ..., the text as _text, and _words, _spans, _items.

    The benchmark is a stated set, searched in blocks of bounded size: a block is collected, sent
    to the tasks and searched in every shard. Blocks follow each other inside the same tasks, so
    there is no shuffle however many there are.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item_id") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    d = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("_text"))
    d = d.selectExpr("*", "0L _words", "cast(array() as array<struct<start:int,end:int>>) _spans", "cast(array() as array<string>) _items")
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        d = _pass(d, [(r["item_id"], r["text"]) for r in block])
    return d


def find(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """Occurrences of benchmark windows: doc_id, n_words, spans (merged, in words), items (sorted ids).

    A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null and empty
    texts have no words and no hits; a null item_id counts as the empty string, repeated item_ids as one;
    items without words never occur. Rows are independent, so equal rows get equal results; an
    empty table gives no rows, an empty benchmark no hits. Other columns don't matter.
    """
    d = annotate(docs.select("doc_id", "text"), benchmark, **options)
    return d.select(F.col("_0").alias("doc_id"), F.col("_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated."""
    f = find(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return f.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` without any occurrence, with the columns of ``docs``."""
    d = annotate(docs, benchmark, **options)
    return d.where(F.size("_spans") == 0).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


_WORD_CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text: str, spans: Sequence[dict]) -> str:
    """``text`` without the words of ``spans`` and what stands between them; the rest stays as it is."""
    at = [m.span() for m in _WORD_CHARS.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "".join([*out, text[last:]])


def remove(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """``docs`` with the merged spans cut out of the texts instead of dropping their rows.

    The words beside a cut become neighbours, so a second pass can find a window across it.
    """
    d = annotate(docs, benchmark, **options)
    shorter = F.udf(lambda t, s: t if t is None or not s else cut(t, s), "string")
    text = F.when(F.size("_spans") == 0, F.col("_text")).otherwise(shorter("_text", "_spans"))
    return d.select(*[(text if c == "text" else F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])
