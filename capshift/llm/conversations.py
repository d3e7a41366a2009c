"""Turns of conversations in order, without putting one conversation into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capshift.llm.common import materialise


def turn_digests(rows: DataFrame) -> list[Column]:
    """(t1, t2): 128 bits of the SHA-256 of a turn's role and text, as two longs."""
    content = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)

    def piece(at: int) -> Column:  # 60 bits each way of a hexadecimal digest fit a long without a sign
        return F.conv(F.substring(content, at, 15), 16, 10).cast("long")

    return [piece(1).alias("t1"), piece(16).alias("t2")]


def in_order(turns: DataFrame, order: list[Column], key: str = "conv_id") -> DataFrame:
    """``turns`` with their place ``i`` (from 1) in their conversation by ``order``; a written table.

    Rows are dealt by ranges of (conversation, order, row), so a conversation of a third
    of all rows, or a third of all rows with one and the same content, lies in many parts.
    Places are counted inside a part and moved on by what earlier parts hold: at most one
    conversation of a part began before it, so those offsets are as few as the parts.
    """
    full = [F.col(key).asc_nulls_first(), *order, F.col("uid")]
    numbered = materialise(turns.withColumn("uid", F.monotonically_increasing_id()), "turns")
    dealt = materialise(numbered.repartitionByRange(*full).withColumn("part", F.spark_partition_id()), "turns-dealt")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("before", F.sum("n").over(before)).where("before > 0")
               .select(F.col(key).alias("_key"), F.col("part").alias("_part"), "before"))
    local = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order, F.col("uid")))
    placed = dealt.withColumn("_i", local).join(
        F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    placed = placed.withColumn("i", F.col("_i") + F.coalesce("before", F.lit(0)))
    return materialise(placed.drop("_i", "_key", "_part", "before", "part", "uid"), "turns-placed")


def running_sums(rows: DataFrame, key: str, at: str, values: list[str], block: int = 1024) -> DataFrame:
    """``rows`` with every column of ``values`` replaced by its sum over the rows of ``key`` up to ``at`` (1, 2, ...).

    Sums run inside blocks of consecutive places; the blocks' totals run over a
    thousandth of the rows. No task holds more than a block of a long sequence.
    """
    rows = rows.withColumn("_block", F.floor((F.col(at) - 1) / block).cast("long"))
    inside = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select(key, "_block", *[F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values])
    summed = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(totals.where("_block > 0"), [key, "_block"], "left")
    return (summed.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values})
            .drop("_block", *[f"_{v}" for v in values]))
