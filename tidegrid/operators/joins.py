"""Joins of per-subject frames: by time, by position, and by looking back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.features import by_time, so_far
from tidegrid.session import checkpointed

KEYS = ("subject_id", "us")


def with_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the columns of right at the same subject and time, NULL where it has none. Both are clustered by subject after window
    steps, so no further shuffle is needed. Columns both have are taken from left. An empty right adds NULL columns."""
    extra = [c for c in right.columns if c in KEYS or c not in left.columns]
    return left.join(right.select(*extra), list(KEYS), "left")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _row, its place from 0 in the given order. Rows are sorted by ranges and kept; the sizes of the partitions
    (one number each) shift the places within them, so no task sorts everything."""
    kept = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", (before - F.col("first")).alias("_shift"))  # one row a partition
    return kept.join(F.broadcast(shifts), "_part").withColumn("_row", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def side_by_side(left: DataFrame, right: DataFrame, left_order: tuple[str, ...], right_order: tuple[str, ...]) -> DataFrame:
    """Rows of both frames paired by their place; the longer one's rest meets NULLs. For frames without a common key only."""
    return numbered(left, *left_order).join(numbered(right, *right_order), "_row", "full").drop("_row")


def at_lag(column: str, minutes: int) -> Column:
    """Value exactly so many minutes before, NULL where no row lies there."""
    d = minutes * 60_000_000
    return F.first(column).over(by_time().rangeBetween(-d, -d))


def last_time(condition: Column) -> Column:
    """Time of the last row, up to this one, where the condition held."""
    return F.last(F.when(condition, F.col("us")), True).over(so_far())
