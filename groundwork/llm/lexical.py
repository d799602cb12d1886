"""Ranked lexical search of a stated item set against all documents, by dense blocked matrix products.

The terms of a block of items are its vocabulary. A scan counts them in every document; the counts are staged,
and a second pass turns them into tiles: the documents' impacts over the vocabulary columns that the
tile holds, times the items' weights over the same columns, both float64. Every product and
partial sum of a tile is an integer below 2^53, so the sums are exact; tiles add up in 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import find_words, span_hashes, stage, text_slices

BLOCK_ITEMS, BLOCK_BYTES = 512, 1 << 22  # items and bytes of item texts that one pass takes
DOCS, COLUMNS = 1024, 1024  # sides of an impact tile
EXACT = 1 << 53
IMPACT = 1_000_000  # no impact reaches it
_LAST = np.iinfo(np.int64).max

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Vocabulary:
    """The terms of a block of items, found by 64-bit hash and length."""

    def __init__(self, texts: Sequence[str]) -> None:
        sets = [set(_TERM.findall(t.translate(_LOWER))) for t in texts]
        terms = sorted(set().union(*sets))
        number = {t: k for k, t in enumerate(terms)}
        self.size = len(terms)
        self.items = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.terms = np.array([number[t] for s in sets for t in sorted(s)], np.int64)
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        lengths = np.diff(ends, prepend=0)
        hashes = span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - lengths, ends)
        self.order = np.argsort(hashes)
        self.hashes, self.lengths = hashes[self.order], lengths[self.order]

    def count(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms per text; text, term and occurrences of every vocabulary term in a text, by text."""
        data = _BYTES[data]
        starts, ends, first = find_words(_IS_TERM, data, off)
        n = np.diff(first)
        if not self.size or not len(starts):
            return n, *[np.zeros(0, np.int64)] * 3
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == ends - starts))
        text = np.searchsorted(first, hit, side="right") - 1
        pair, tf = np.unique(text * self.size + self.order[at[hit]], return_counts=True)
        return n, pair // self.size, pair % self.size, tf


def _counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n, terms and tfs of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, off in text_slices(b.column("text")):
                n, text, term, tf = vocabulary.count(data, off)
                ends = np.searchsorted(text, np.arange(len(n) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (term, tf)]
                keep = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(n)), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"]).filter(keep)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _holders(counts: DataFrame, size: int) -> np.ndarray:
    """Documents that hold a term, for every term of the vocabulary; added up in every task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in counts.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a vocabulary term
        df[r["term"]] = r["df"]
    return df


class Best:
    """The k best documents of every item so far, by (score, least doc_id), as rows sorted by item."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.rows = [np.zeros(0, np.int64)] * 3  # item, score, doc
        self.least, self.last = np.zeros(items, np.int64), np.full(items, _LAST)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: (documents, items). What ties with the k-th stays in play until doc_ids decide."""
        floor = self.least
        if len(docs) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(docs) - self.k, axis=0)[len(docs) - self.k])
        row, item = np.nonzero((scores >= floor) & (scores > 0))
        score, doc = scores[row, item], docs[row]
        new = (score > self.least[item]) | (doc <= self.last[item])
        item, score, doc = (np.concatenate([a, b[new]]) for a, b in zip(self.rows, (item, score, doc), strict=True))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.rows = [item[keep], score[keep], doc[keep]]
        full = place == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]


def _best(counts: DataFrame, vocabulary: Vocabulary, ids: pa.Array, kind: str, k: int) -> DataFrame:
    """item_id, doc_id, score of the k best documents of every item in every task."""
    total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    df = _holders(counts, vocabulary.size)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    width = min(COLUMNS, max(1, (EXACT - 1) // (IMPACT * max(1, int(weight.max(initial=0))))))
    items, terms = vocabulary.items, vocabulary.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for b in batches:
            for i in range(0, b.num_rows, DOCS):
                part = b.slice(i, DOCS)
                n = part.column("n").to_numpy()
                lists = part.column("terms")
                tf, term = part.column("tfs").flatten().to_numpy().astype(np.int64), lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                m = 10 + (90 * n * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                used, column = np.unique(term, return_inverse=True)
                place = np.full(vocabulary.size, -1)
                place[used] = np.arange(len(used))
                at = place[terms]
                scores = np.zeros((len(n), len(ids)), np.int64)
                for c in range(0, len(used), width):
                    cells, entries = (column >= c) & (column < c + width), (at >= c) & (at < c + width)
                    side = min(width, len(used) - c)
                    impacts, weights = np.zeros((len(n), side)), np.zeros((side, len(ids)))
                    impacts[doc[cells], column[cells] - c] = impact[cells]
                    weights[at[entries] - c, items[entries]] = weight[terms[entries]]
                    scores += (impacts @ weights).astype(np.int64)
                best.add(scores, part.column("doc_id").fill_null(_LAST).to_numpy())
        item, score, found = best.rows
        out = [ids.take(pa.array(item)), pa.array(found, mask=found == _LAST), pa.array(score)]
        yield pa.RecordBatch.from_arrays(out, ["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def _blocks(items: DataFrame, most: int, most_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of bounded size, one sorted partition after the other; rows of one item_id are one item."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).sort("item_id").toLocalIterator():
        if ids and r["item_id"] == ids[-1]:
            texts[-1] += " " + r["text"]
        else:
            if ids and (len(ids) >= most or size + len(r["text"]) > most_bytes):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(r["item_id"])
            texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item, over whole texts.

    A term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A term weighs
    floor(1000 ln((2N+2) / (2 df+1))); a document adds weight * (10^9 tf div (1000 tf + 8 m)) for every
    distinct term of the item, where m = 10 + 90 n N div L. Scores above 0 are ranked from the
    highest, equal ones by ascending doc_id.

    Null and empty texts have no terms: such a document counts nowhere, such an item has no rows. Rows of one
    item_id are one item with the terms of all of them; null is an item_id like any other. Every row of ``docs``
    is a document of its own, so repeated rows take a rank each; a null doc_id comes after all others. Empty
    tables give no rows, other columns don't matter; ids of documents are integers.

    The items are a stated set: each block of at most ``block_items`` items and about ``block_bytes`` of text (one
    longer item alone) takes a scan of the texts, a staged table of counts and a pass over that. What is sent to
    the tasks is bounded by the block, what comes back by ``k`` rows per item and task.
    """
    kind = dict(items.dtypes)["item_id"]
    found = None
    for ids, texts in _blocks(items, block_items, block_bytes):
        vocabulary = Vocabulary(texts)
        counts = stage(_counts(docs, vocabulary), "lexical-counts")
        best = stage(_best(counts, vocabulary, pa.array(ids), kind, k), "lexical-best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
