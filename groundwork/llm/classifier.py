"""Quality scores from supervised subword embeddings, trained with numpy.

A document is the average of learned vectors: one for each hashed word, each hashed run of three and
of four bytes inside the text, and one that stands for a word equal to the word before it. A softmax
over two classes reads the average. Training is stochastic gradient descent over a bounded sample;
for scoring, the vectors and the output layer fold into one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import draw, find_words, held_out, span_hashes, stage, text_slices

BUCKET_BITS = 16
DIM = 12
GRAMS = (3, 4)
#: Bounds of the training sample: labelled rows, and distinct buckets over all of them.
SAMPLE_ROWS, SAMPLE_BUCKETS = 4000, 1 << 24
EPOCHS, RATE, SEED = 8, 0.5, 4
THRESHOLD = 0.3
REPEAT = 0  # the bucket of a repeated word; other features may fall into it as into any bucket
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def feature_streams(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: buckets in text order, and the first one of each text (one more at the end)."""
    starts, ends, first = find_words(_WORD, data, off)
    words = span_hashes(data, starts, ends)
    same = np.flatnonzero(words[1:] == words[:-1]) + 1
    same = same[~np.isin(same, first)]  # the first word of a text repeats nothing
    out = [(_bucket(words), first), (np.full(len(same), REPEAT), np.searchsorted(same, first))]
    x = data.astype(np.uint64)
    for n in GRAMS:
        count = max(0, len(x) - n + 1)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h |= x[k : k + count] << np.uint64(8 * (k + 1))
        whole = np.ones(count, bool)
        for k in range(1, n):  # a run may not reach into the next text
            bad = off[1:-1] - k
            whole[bad[(bad >= 0) & (bad < count)]] = False
        at = np.flatnonzero(whole)
        out.append((_bucket(h[at]), np.searchsorted(at, off)))
    return out


def bags(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their counts."""
    streams = feature_streams(data, off)
    out = []
    for i in range(len(off) - 1):
        out.append(np.unique(np.concatenate([b[at[i] : at[i + 1]] for b, at in streams]), return_counts=True))
    return out


def train(samples: Sequence[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Fit vectors and output layer to (label, buckets, counts); returns a weight per bucket and an offset.

    One document a step, in a new seeded order each epoch, with a rate that falls to zero. The step of a
    bucket's vector is scaled by the root of the sample's mean bag size, as an average spreads its gradient
    over all members.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bagged = [(y, ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)) for y, ids, n in samples]
    if bagged:
        share = np.clip(sum(y for y, *_ in bagged) / len(bagged), 0.01, 0.99)
        bias[:] = np.log([1 - share, share])
    spread = float(np.sqrt(np.mean([1 / max(float(w @ w), 1e-6) for *_, w in bagged if len(w)] or [1.0])))
    steps, done = epochs * len(bagged), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bagged)):
            y, ids, w = bagged[k]
            now = rate * (1 - done / steps)
            done += 1
            own = vectors[ids]
            mean = w @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = g @ layer
            layer -= now * np.outer(g, mean)
            bias -= 0.02 * now * g
            vectors[ids] = own - (now * spread) * w[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score_slice(data: np.ndarray, off: np.ndarray, weights: np.ndarray, offset: float) -> np.ndarray:
    total, n = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for buckets, at in feature_streams(data, off):
        sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
        total += sums[at[1:]] - sums[at[:-1]]
        n += np.diff(at)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + offset, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, buckets: int = SAMPLE_BUCKETS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Bags of at most ``rows`` labelled documents outside the held-out fold, drawn by a seeded hash.

    The list ends early when its bags would hold more than ``buckets`` entries, so that its size is
    bounded however long the documents are. Labels other than 0 and 1 don't count; several labels
    of one document become their rounded mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bag for _, _, data, off in text_slices(b.column("text")) for bag in bags(data, off)]
            cols = [b.column("y"), b.column("u"), b.column("t"), pa.array([len(x) for x, _ in found], pa.int64()), pa.array([x.astype("<u2").tobytes() for x, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["y", "u", "t", "n", "ids", "counts"])

    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    drawn = stage(y.withColumn("u", draw(SEED, F.col("doc_id"))).orderBy("u", "doc_id").limit(rows), "classifier-drawn")
    texts = docs.select("doc_id", "text").join(drawn, "doc_id").select("y", "u", F.xxhash64("text").alias("t"), "text")
    found = stage(texts.mapInArrow(run, "y int, u long, t long, n long, ids binary, counts binary"), "classifier-bags")
    # at most ``rows`` documents pass this window
    upto = Window.orderBy("u", "t").rowsBetween(Window.unboundedPreceding, 0)
    keep = found.select("u", "t", F.sum("n").over(upto).alias("_all"), F.row_number().over(Window.orderBy("u", "t")).alias("_r")).where((F.col("_all") <= buckets) & (F.col("_r") <= rows)).select("u", "t").distinct()
    got = found.join(keep, ["u", "t"], "left_semi").orderBy("u", "t").limit(rows).collect()
    return [(r["y"], np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["counts"], "<u4")) for r in got]


def score(docs: DataFrame, weights: np.ndarray, offset: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, from its text alone; one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [score_slice(data, off, weights, offset) for _, _, data, off in text_slices(b.column("text"), 1 << 20)]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate([np.zeros(0), *found]))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn quality from ``labels`` and score every document: doc_id, held_out, score, predicted.

    Null and empty texts have no features and get the base rate of label 1; whole texts are read;
    equal texts get equal scores; without labels all scores are 0.5; an empty table gives no rows.
    Columns other than doc_id and text don't matter. The model is one number per bucket, sent with the task.
    """
    weights, offset = train(training_sample(docs, labels))
    return score(docs, weights, offset)
