"""Shared pieces: staging in the cluster's folder, seeded order, ranks without a hot window."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

HELD_OUT_FOLDS = 5


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, keeps known sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fold that learning never sees; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def key_of(c: Column) -> Column:
    """A non-null text key: null and the empty string stay apart and join like any value."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def draw(seed: int, *cols: Column) -> Column:
    """A seeded 48-bit number per row, the same on every run and every engine that has md5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 12), 16, 10).cast("long")


DRAW_BITS = 48


def root_bits(n: int) -> int:
    """Bits of a bucket number such that buckets, and rows in a bucket, are both about sqrt(n)."""
    return max(0, math.ceil(math.log2(max(1, n)) / 2))


def rank_within(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str], rank: str, total: str | None = None, per_key: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """1-based rank of every row inside ``keys`` by (``order[0]``, a draw, then the rest of ``order``).

    A window over the keys would put a hot key into one task. Here each key is cut by the high bits
    of the draw; buckets are counted with map-side combine, their counts summed up per key, and only
    bucket-sized groups are sorted. Rows equal in all of ``order`` are interchangeable. ``per_key``
    adds its columns to the rows by way of the bucket counts, so that a hot key meets no row in a join.
    ``counted`` is a narrower copy of ``df`` to count the buckets in, where ``df`` carries texts.
    """
    keys = list(keys)
    bucket = F.shiftright(F.col(order[0]), DRAW_BITS - root_bits(n))
    d = df.withColumn("_bucket", bucket)
    narrow = d if counted is None else counted.withColumn("_bucket", bucket)
    counts = narrow.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_before", F.coalesce(F.sum("_c").over(run), F.lit(0)))
    if total:
        offs = offs.withColumn(total, F.sum("_c").over(Window.partitionBy(*keys)))
    if per_key is not None:
        offs = offs.join(per_key, keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = d.withColumn("_r", F.row_number().over(inside)).join(offs.drop("_c"), [*keys, "_bucket"])
    return out.withColumn(rank, F.col("_before") + F.col("_r")).drop("_r", "_before", "_bucket")


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of the (src, dst) edges; the component is its smallest node.

    Each round every node takes its smallest neighbour as parent (an aggregate with map-side combine, so a hub
    is no hot spot), the parent's parent after that, and the edges are drawn between what the nodes
    have become. Edges inside one part vanish, so the graph shrinks until none is left.
    """
    e = stage(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{name}-edges")
    label = None
    while True:
        ends = e.select(F.col("src").alias("node"), F.col("src").alias("least")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("least")))
        p = stage(ends.groupBy("node").agg(F.min("least").alias("parent")), f"{name}-parents")
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("_top"))
        p = stage(p.join(up, "parent").select("node", F.col("_top").alias("parent")), f"{name}-tops")
        if label is None:
            label = p.withColumnRenamed("parent", "component")
        else:
            label = label.join(p.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            label = stage(label, f"{name}-labels")
        e = e.join(p.select(F.col("node").alias("src"), F.col("parent").alias("a")), "src").join(p.select(F.col("node").alias("dst"), F.col("parent").alias("b")), "dst")
        e = stage(e.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), f"{name}-edges")
        if not e.head(1):
            return label


# ---- text columns in Arrow batches -------------------------------------------------------------

def text_slices(col: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def find_words(is_word: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a slice, and the first word of every text (one more at the end).

    ``is_word`` tells for each byte value whether it belongs to a word; a text's end ends a word.
    """
    w = is_word[data]
    before = np.zeros(len(w) + 1, bool)
    before[1:] = w
    before[off] = False
    starts = np.flatnonzero(w & ~before[:-1])
    after = np.zeros(len(w) + 1, bool)
    after[:-1] = w
    after[off] = False
    ends = np.flatnonzero(w & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


_MUL = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x100000001B3)
_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _INV)):
            a = np.full(max(n, 1 << 21), base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over the bytes from prefix sums, mixed."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _MUL)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive word hashes from each position (the last ones run out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _MUL
        h += words[k : k + n]
    return mix(h)
