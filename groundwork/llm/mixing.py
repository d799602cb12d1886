"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import draw, key_of, rank_within, stage

SEED = 10
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: The last words of a budget that the exact table covers; larger rests are first filled greedily.
TABLE = 8192


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: float = MOST_TIMES) -> DataFrame:
    """Target words of every source: (_s, source_size) -> plus weight, target.

    Sources in code point order, null last, take ``weights`` in turn. ``share`` of all words is dealt by
    weight; a source stops at ``most`` times its size and the excess is dealt again until none is
    above. That is one level L with target = min(weight * L, most * size): sources sorted by the level
    at which they fill up give it from running sums. One row per source passes the windows.
    """
    order = Window.orderBy(F.when(F.col("_s") == "", 1).otherwise(0), "_s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.withColumn("weight", w).withColumn("_cap", F.col("source_size") * float(most))
    everything = Window.partitionBy(F.lit(1))
    full = Window.orderBy(F.col("_cap") / F.col("weight"), "_s")
    upto, before = full.rowsBetween(Window.unboundedPreceding, 0), full.rowsBetween(Window.unboundedPreceding, -1)
    src = (
        src.withColumn("_all", F.sum("source_size").over(everything) * float(share))
        .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_filled", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    )
    # the level if all sources before this one are full and this and later ones are not
    level = (F.col("_all") - F.col("_filled")) / F.col("_w")
    src = src.withColumn("_open", level * F.col("weight") <= F.col("_cap")).withColumn("_level", F.when(F.col("_open"), level))
    src = src.withColumn("_level", F.first("_level", ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return src.select("_s", "source_size", "weight", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_level"))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near ``budget`` as can be.

    All lengths, rare ones too, give their share: running counts are rounded from the shortest to the longest
    length, so that runs of neighbouring lengths are in proportion. The last words are
    fitted by a bounded knapsack over the documents left. If its sums miss the budget, the
    shares leave more words to it, up to TABLE, and the nearest fit is taken.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    best, miss, room = np.zeros_like(counts), budget, 0
    while True:
        take = _fit_last(lengths, counts, _shares(lengths, counts, (budget - room) / total), budget)
        off = abs(int((take * lengths).sum()) - budget)
        if off < miss:
            best, miss = take, off
        if miss == 0 or room >= min(TABLE, budget):
            return best
        room = min(TABLE, budget, max(4 * room, int(lengths.max())))


def _shares(lengths: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """``share`` of the documents in the order of their lengths: rounded running counts, so off by less than one in any run."""
    order = np.argsort(lengths, kind="stable")
    # the share of a count may overflow 64 bits in whole numbers, so floats, rounded down and bounded
    upto = np.floor(np.cumsum(counts[order]) * share + 0.5).astype(np.int64)
    take = np.zeros_like(counts)
    take[order] = np.clip(np.diff(upto, prepend=0), 0, counts[order])
    return take


def _fit_last(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int) -> np.ndarray:
    """``take`` with the words fitted that it lacks, or has too many of."""
    rest = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest < 0 and take[i]:
            back = min(int(take[i]), -(rest // int(lengths[i]))) if lengths[i] else 0
            take[i] -= back
            rest += back * int(lengths[i])
        if rest <= TABLE:
            continue
        more = min(int(counts[i] - take[i]), (rest - TABLE) // int(lengths[i])) if lengths[i] else 0
        take[i] += more
        rest -= more * int(lengths[i])
    for i in order:  # supply of short documents may have run out above
        if rest > 2 * TABLE and lengths[i]:
            more = min(int(counts[i] - take[i]), rest // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    if rest <= 0:
        return take
    left = counts - take
    if rest > 2 * TABLE:  # every document left is longer than the rest: the shortest of them or none
        i = min(np.flatnonzero((lengths > 0) & (left > 0)), key=lambda i: lengths[i], default=None)
        if i is not None and lengths[i] - rest < rest:
            take[i] += 1
        return take
    size = 2 * rest  # the nearest sum may lie above, but none beyond this is nearer than taking nothing
    usable = np.flatnonzero((lengths > 0) & (lengths <= size) & (left > 0))
    item, used = np.full(size + 1, -1, np.int64), np.zeros(size + 1, np.int64)
    reached = np.zeros(size + 1, bool)
    reached[0] = True
    for i in usable[np.argsort(-lengths[usable], kind="stable")]:  # longest first: few documents, so the shares hardly change
        n, most = int(lengths[i]), int(left[i])
        rows = -(-(size + 1) // n)
        grid = np.zeros(rows * n, bool)
        grid[: size + 1] = reached
        grid = grid.reshape(rows, n)
        here = np.where(grid, np.arange(rows)[:, None], -1 - most - rows)
        gap = (np.arange(rows)[:, None] - np.maximum.accumulate(here, axis=0)).reshape(-1)[: size + 1]
        new = ~reached & (gap <= most)
        item[new], used[new] = i, gap[new]
        reached |= new
        if reached[rest]:
            break
    sums = np.flatnonzero(reached)
    v = int(sums[np.argmin(np.abs(sums - rest))])
    while v:
        i, k = item[v], used[v]
        take[i] += k
        v -= int(k * lengths[i])
    return take


def _fit_source(h: pd.DataFrame) -> pd.DataFrame:
    h = h.sort_values("size")
    size, target = int(h.source_size.iloc[0]), float(h.target.iloc[0])
    whole = int(target // size) if size else 0
    extra = fit(h["size"].to_numpy(np.int64), h["_n"].to_numpy(np.int64), round(target - whole * size))
    return pd.DataFrame({"_s": h._s, "size": h["size"], "_whole": whole, "_extra": extra})


def _mixed(docs: DataFrame, carry: Sequence[str], weights: Sequence[int], share: float, most: int, seed: int) -> DataFrame:
    """doc_id, size, source_size, target and times of every row, and its ``carry`` columns as _0, _1, ..."""
    own = [
        F.col("doc_id"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        key_of(F.col("source")).alias("_s"), draw(seed, F.col("doc_id")).alias("_u"),
    ]
    rows = stage(docs.select(*own), "mix-rows")
    n = rows.count()
    hist = stage(rows.groupBy("_s", "size").agg(F.count(F.lit(1)).alias("_n")), "mix-lengths")
    sizes = hist.groupBy("_s").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    goal = stage(targets(sizes, weights, share, most), "mix-targets")
    plan = hist.join(goal, "_s").groupBy("_s").applyInPandas(_fit_source, "_s string, size long, _whole long, _extra long")
    plan = stage(plan.join(goal, "_s"), "mix-plan")
    # documents of one source and length, in seeded order
    wide = docs.select(*own, *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]) if carry else rows
    ranked = rank_within(wide, ["_s", "size"], n, ["_u", "doc_id"], "_rank", per_key=plan, counted=rows)
    times = F.col("_whole") + F.when(F.col("_rank") <= F.col("_extra"), 1).otherwise(0)
    return ranked.withColumn("times", times.cast("int"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """How often each document enters the mixture, and the words it brings.

    Output: doc_id, size (words ``[^\\x20\\x09-\\x0D]+`` of the text, null 0), source_size, target
    (words its source should bring), taken (words taken, repeats counted), times.
    A source takes all its documents floor(target / size) times; the remaining budget is fitted per
    exact document length (``fit``), and the documents of a length are taken in seeded order.
    A source lacking documents of fitting length ends at the nearest sum the table reaches.

    Null source is a source of its own; empty texts have no words and bring none; equal rows are
    interchangeable; an empty table gives no rows; a source without words has target 0; other columns don't
    matter. Only the (source, length) counts of one source, never its documents, meet in one task.
    """
    m = _mixed(docs, (), weights, share, most, seed)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def repeat(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it, in the columns of ``docs``."""
    m = _mixed(docs, docs.columns, weights, share, most, seed).where("times > 0")
    m = m.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return m.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
