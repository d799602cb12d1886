"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark prunes to ``k`` rows per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is shuffled, whatever its estimated size.

    Estimates after generated text, a Python function or a checkpoint come from the small columns read; a side
    believed to be a few MB may be GB, and broadcasting it goes through the driver.
    """
    return df.hint("merge")


def per_key(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """A written table of one row per key, as a join side: broadcast up to ``limit`` counted rows, else shuffled.

    Joining on a key of few values would deal all rows of the other side to as many tasks.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else shuffled(df)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per key, by an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pair_blocks(df: DataFrame, keys: Sequence[str], item: str, payload: Sequence[str] = (), block: int = 512) -> DataFrame:
    """Unordered item pairs inside a key, hot keys cut into block pairs.

    A key with n items becomes ceil(n/block) hash blocks; every block pair is its own join key,
    so no task sees more than about block x block pairs whatever the size of the key.
    Items must be distinct within a key.
    """
    keys = list(keys)
    cols = [item, *payload]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = df.join(sizes, keys).where("_n > 1")
    b = b.withColumn("_nb", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    b = b.withColumn("_b", F.pmod(F.xxhash64(item), F.col("_nb")).cast("int"))
    upto = F.sequence(F.lit(0), F.col("_nb") - 1)
    # block pair (i, j) with i <= j: a row of block _b is on the left of (_b, j>=_b) and on the right of (i<=_b, _b)
    left = b.select(
        *keys, *[F.col(c).alias(f"{c}_a") for c in cols], F.col("_b").alias("_i"),
        F.explode(F.filter(upto, lambda j: j >= F.col("_b"))).alias("_j"),
    )
    right = b.select(
        *keys, *[F.col(c).alias(f"{c}_b") for c in cols], F.col("_b").alias("_j"),
        F.explode(F.filter(upto, lambda i: i <= F.col("_b"))).alias("_i"),
    )
    same = (F.col("_i") != F.col("_j")) | (F.col(f"{item}_a") < F.col(f"{item}_b"))
    j = left.join(right, [*keys, "_i", "_j"]).where(same).drop("_i", "_j")
    swap = F.col(f"{item}_a") > F.col(f"{item}_b")
    out = list(keys)
    for c in cols:
        out.append(F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"))
        out.append(F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b"))
    return j.select(*out)


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, tuple[float, Callable[[Column], Column]]],
    small: int = 20_000,
) -> DataFrame:
    """Exact order statistics per key, without sorting a whole key in one task.

    ``picks`` maps an output column to (quantile, index rule); the rule turns the count into the
    zero-based position in the ascending list. A mergeable sketch gives a narrow value band around
    each quantile; rows below the band are only counted, and the rank is resolved among the
    distinct values in the band. Keys of at most ``small`` rows use the whole range as band.
    Output: keys, ``n`` and one column per pick.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull())
    if not keys:
        src = src.withColumn("_all", F.lit(1))
        keys = ["_all"]
    src = src.select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(picks)
    qs = [x for n in names for x in (max(0.0, picks[n][0] - 5e-4), min(1.0, picks[n][0] + 5e-4))]
    head = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", qs, 10_000).alias("_q")
    )
    inf = F.lit(float("inf"))
    bands = [
        F.struct(
            F.lit(n).alias("pick"),
            F.when(F.col("n") <= small, -inf).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when(F.col("n") <= small, inf).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
            picks[n][1](F.col("n")).cast("long").alias("idx"),
        )
        for i, n in enumerate(names)
    ]
    head = head.select(*keys, "n", F.array(*bands).alias("_b"))
    marked = src.join(head, keys).select(*keys, "n", "_v", F.explode("_b").alias("b"))
    marked = marked.select(*keys, "n", "_v", "b.*").where(F.col("_v") <= F.col("hi"))
    # one row per (key, pick, value in band); everything below the band collapses to one row at -inf
    slot = F.when(F.col("_v") < F.col("lo"), -inf).otherwise(F.col("_v"))
    counted = marked.groupBy(*keys, "n", "pick", "idx", slot.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "pick").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(w)).where(F.col("_cum") > F.col("idx"))
    chosen = ranked.groupBy(*keys, "n", "pick").agg(F.min("_v").alias("_v"))
    out = chosen.groupBy(*keys, "n").pivot("pick", names).agg(F.first("_v"))
    return out.drop("_all") if "_all" in keys else out


# The three index rules found in the reported metrics.
def floor_index(p: float) -> tuple[float, Callable[[Column], Column]]:
    """Position int(n * p), at most n - 1."""
    return p, lambda n: F.least(n - 1, F.floor(n * F.lit(p)))


def round_index(p: float) -> tuple[float, Callable[[Column], Column]]:
    """Position round(p * (n - 1)), half-even."""
    return p, lambda n: F.least(n - 1, F.bround(F.lit(p) * (n - 1), 0))
