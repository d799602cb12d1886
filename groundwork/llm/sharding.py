"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import draw, key_of, rank_within, root_bits, stage

SEED = 20


def interleave(docs: DataFrame, shards: int = 16, seed: int = SEED, stratum: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Put every row into one of ``shards`` shards so that each has the mixture of the whole.

    Inside each stratum the rows get a seeded-shuffled rank; rank over stratum size, shifted by a
    share of a rank that belongs to the stratum, is the fractional rank. All rows are sorted by it
    and cut into runs whose row counts differ by at most one. Any run of the order holds
    every stratum in proportion, to within a row or so.

    Output: doc_id, size (UTF-8 bytes of text plus 1, null text counts as none), text_crc32, law
    (``rows``), shard, slot (0, 1, ... inside the shard), grown_shard (null: this law moves rows
    when a shard is added), then ``carry``.
    Null doc_id, text or stratum are values like others; equal rows are interchangeable; an empty
    table gives no rows; a stratum of one row lands anywhere. Other columns don't matter.

    Neither a stratum nor the whole table is sorted in one task: both orders are cut into about
    sqrt(n) buckets that are counted first and ranked one by one (``rank_within``).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.octet_length(text).cast("long").alias("_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"),
        key_of(F.col(stratum)).alias("_s"), draw(seed, F.col("doc_id")).alias("_u"), *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    rows = stage(rows, "shard-rows")
    n = rows.count()
    ranked = rank_within(rows, ["_s"], n, ["_u", "doc_id", "text_crc32"], "_rank", "_of")
    shift = (draw(seed, F.col("_s")) + 0.5) / float(1 << 48)
    ranked = stage(ranked.withColumn("_f", (F.col("_rank") - shift) / F.col("_of")), "shard-ranks")

    parts = 1 << root_bits(n)
    ranked = ranked.withColumn("_part", F.least(F.floor(F.col("_f") * parts), F.lit(parts - 1)))
    # at most ``parts`` (about sqrt of the rows) counts meet in this window
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_f", "_s", "_u", "doc_id", "text_crc32")
    placed = ranked.withColumn("_r", F.row_number().over(inside)).join(counts, "_part")
    placed = placed.withColumn("_pos", F.col("_before") + F.col("_r") - 1)
    placed = placed.withColumn("_shard", F.expr(f"(_pos * {shards}L) div {max(n, 1)}L"))
    return placed.select(
        "doc_id", (F.col("_bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_pos - (_shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder per shard, each file in slot order; a large shard may take several files."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
