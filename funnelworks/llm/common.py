"""Shared helpers: the test tables, positions in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.session import discard, stored

__all__ = ["discard", "stored", "table", "with_position"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_position(df: DataFrame, *order: Column, position: str = "position", name: str = "ordered") -> DataFrame:
    """``df`` plus a gapless position from 0 in the given total order.

    A distributed sort numbers the rows within each sorted partition; the
    sorted rows are stored (``discard`` takes the result), and a running sum over the partitions' row counts
    (one row a partition) gives each partition its offset.  No task ever sees
    more than its own range.  Rows that tie on ``order`` get positions in any
    order, so pass enough columns where that matters.
    """
    spark = df.sparkSession
    numbered = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy(part).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part_id, n in sizes:
        offsets.append((part_id, total))
        total += n
    starts = spark.createDataFrame(offsets, "_part long, _offset long")  # a row per partition
    placed = (
        numbered.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(starts), "_part")
        .withColumn(position, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_offset")
    )
    placed._stored_at = numbered._stored_at
    return placed
