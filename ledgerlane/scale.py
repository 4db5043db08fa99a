"""Building blocks that keep large or skewed groups spread over many tasks.

* ``top_per`` keeps k rows per key; Spark limits inside each input partition first.
* ``global_row_number`` numbers a whole table without a single-task window.
* ``running`` is a prefix maximum/sum per key that splits a hot key into buckets.
* ``group_ranks`` gives exact ranks inside groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed

ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def top_per(df: DataFrame, keys, order, k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def placed_everywhere(df: DataFrame, order) -> DataFrame:
    """Range-partitioned, sorted and checkpointed, with partition and row numbers.

    The checkpoint pins the range bounds: they are sampled, so a recomputed exchange
    could place rows differently and break the offsets derived from it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    spot = F.monotonically_increasing_id()
    return checkpointed(
        placed.select("*", F.shiftright(spot, ROW_BITS).alias("_pid"), spot.bitwiseAND((1 << ROW_BITS) - 1).alias("_row"))
    )


def global_row_number(df: DataFrame, order, name: str) -> DataFrame:
    """1-based position of each row in the total order ``order``."""
    placed = placed_everywhere(df, order)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window and the broadcast are bounded by the partition count
    offsets = placed.groupBy("_pid").count().select(
        "_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_skip")
    )
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_row") + F.col("_skip") + 1)
        .drop("_pid", "_row", "_skip")
    )


def running(df: DataFrame, keys, order, bucket: Column, measures: dict, inclusive: bool = False) -> DataFrame:
    """Prefix ``max``/``sum`` per key in ``order``; ``measures`` maps name -> (kind, column).

    ``bucket`` must never decrease along ``order``.  Rows are scanned per (key, bucket), and
    the bucket totals are scanned per key, so a key holding most rows is still split.
    Keys must not be NULL.
    """
    agg = {"max": F.max, "sum": F.sum}
    rows = df.withColumn("_bucket", bucket)
    by_bucket = [*keys, "_bucket"]
    totals = rows.groupBy(*by_bucket).agg(*[agg[kind](c).alias(n) for n, (kind, c) in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by_bucket, *[agg[kind](n).over(earlier).alias(f"_{n}") for n, (kind, _) in measures.items()])
    inside = Window.partitionBy(*by_bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    scanned = rows.select("*", *[agg[kind](c).over(inside).alias(n) for n, (kind, c) in measures.items()])
    joined = scanned.join(carried, by_bucket)
    for n, (kind, _) in measures.items():
        here, back = F.col(n), F.col(f"_{n}")
        merged = F.greatest(here, back) if kind == "max" else F.coalesce(here + back, here, back)
        joined = joined.withColumn(n, merged)
    return joined.drop("_bucket", *[f"_{n}" for n in measures])


def group_ranks(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct values per group with the 1-based rank range their copies cover.

    Output: keys, value, first_rank, last_rank, group_rows.  Equal values are counted before any shuffle
    by value; then one range sort places every group, however large, over many tasks.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed_everywhere(counted, [*keys, value])
    inside = Window.partitionBy(*keys, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    part = placed.groupBy(*keys, "_pid").agg(F.sum("_n").alias("_n"))
    # at most one row per group and range partition
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    skips = part.select(
        *keys, "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_rows"),
    )
    last = F.sum("_n").over(inside)
    return (
        placed.select(*keys, value, "_pid", "_n", last.alias("_last"))
        .join(skips, [*keys, "_pid"])
        .select(
            *keys, value,
            (F.col("_last") + F.col("_skip") - F.col("_n") + 1).alias("first_rank"),
            (F.col("_last") + F.col("_skip")).alias("last_rank"),
            "group_rows",
        )
    )
