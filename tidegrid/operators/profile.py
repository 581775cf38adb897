"""Profiles of canonical records: cohort, coverage, value ranges, missing values, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.session import micros, value_or_null, with_row

HOUR_US = 3_600_000_000


def hours_between(first: str, last: str) -> Column:
    """Number of full hours of the clock that begin between two times (boundaries, not elapsed hours)."""
    hour = lambda c: F.floor(micros(c) / F.lit(HOUR_US))
    return (hour(last) - hour(first)).cast("bigint")


def cohort(df: DataFrame) -> DataFrame:
    """Per subject: first and last time, hours between, counts of glucose, insulin and carbohydrate values."""
    counts = [F.count(value_or_null(v)).alias(n) for v, n in (("glucose", "cgm_rows"), ("insulin", "insulin_rows"), ("carbs", "carb_rows"))]
    df = df.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), *counts)
    return df.withColumn("duration_hours", hours_between("first_ts", "last_ts"))


def core(manifest: DataFrame, days: int = 14, cgm: int = 1000, insulin: int = 1, carbs: int = 1) -> DataFrame:
    """Subjects with enough days and values (all bounds inclusive)."""
    return manifest.where((F.col("duration_hours") >= days * 24) & (F.col("cgm_rows") >= cgm) & (F.col("insulin_rows") >= insulin) & (F.col("carb_rows") >= carbs))


def cohort_stats(manifest: DataFrame, **bounds) -> DataFrame:
    """One row: subjects, core subjects, least, median and most days; medians of the core (NULL without a core)."""
    days = F.col("duration_hours") / 24.0
    every = manifest.agg(F.count("*").alias("n_subjects"), F.min(days).alias("min_days"), F.median(days).alias("median_days"), F.max(days).alias("max_days"))
    middle = core(manifest, **bounds).agg(F.count("*").alias("n_core"), F.median(days).alias("core_median_days"), F.median("cgm_rows").alias("core_median_cgm_rows"))
    return with_row(every, middle)


def glucose_profile(df: DataFrame) -> DataFrame:
    g = value_or_null("glucose")
    df = df.agg(F.count(g).alias("n"), F.min(g).alias("min_glucose"), F.max(g).alias("max_glucose"), F.avg(g).alias("mean_glucose"), F.count_if(g < schema.LOW).alias("n_below_70"), F.count_if(g < schema.VERY_LOW).alias("n_below_54"))
    return df.select("*", *(F.when(F.col("n") > 0, 100.0 * F.col(f"n_below_{t}") / F.col("n")).alias(f"pct_below_{t}") for t in (70, 54)))


def amount_profile(df: DataFrame, columns: Sequence[str] = ("insulin", "basal", "bolus")) -> DataFrame:
    """Per column: values, zeros, negatives, positives and the largest value. One pass; the result is turned."""
    stats = [F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.count_if(v > 0).alias("n_positive"), F.max(v).alias("max_value")) for c in columns for v in (value_or_null(c),)]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def carb_verdict(df: DataFrame, cumulative_above: float = 1000.0) -> DataFrame:
    """Profile of carbs and whether its largest value tells running totals from single meals."""
    return amount_profile(df, ("carbs",)).withColumn("verdict", F.when(F.col("max_value") > cumulative_above, "cumulative").otherwise("discrete"))


def additivity(df: DataFrame) -> DataFrame:
    """How many rows have insulin = basal + bolus: within 1e-4, within 1e-5 absolute plus 1e-5 relative, and exactly."""
    total, parts = value_or_null("insulin"), value_or_null("basal") + value_or_null("bolus")
    gap = F.abs(total - parts)
    return df.agg(F.count(gap).alias("n"), F.count_if(gap < 1e-4).alias("n_within"), F.count_if(gap <= 1e-5 + 1e-5 * F.abs(parts)).alias("n_close"), F.count_if(total == parts).alias("n_exact"))


def years(df: DataFrame) -> DataFrame:
    return df.where(F.col("timestamp").isNotNull()).groupBy(F.year("timestamp").cast("bigint").alias("year")).agg(F.count("*").alias("n"))


def coverage(manifest: DataFrame) -> DataFrame:
    """One row: subjects with at least 1, 7, 14 and 30 days."""
    return manifest.agg(F.count("*").alias("n_subjects"), *(F.count_if(F.col("duration_hours") >= 24 * d).alias(f"n_{d}d") for d in (1, 7, 14, 30)))


def top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of the greatest values of a column (ties by the other columns), the greatest first. k rows are kept a task."""
    return df.orderBy(F.desc_nulls_last(by), *(c for c in df.columns if c != by)).limit(k)


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, missing values (NULL or NaN) and their share in percent. One pass; the result is turned."""
    none = lambda c: value_or_null(c).isNull() if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNull()
    stats = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(none(c)).alias("n_missing")) for c in columns]
    turned = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return turned.withColumn("pct_missing", F.when(F.col("n_rows") > 0, 100.0 * F.col("n_missing") / F.col("n_rows")))


def subjects_seen(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of subjects (by sketch if approximate), first and last time."""
    n = F.approx_count_distinct("subject_id") if approximate else F.countDistinct("subject_id")
    return df.agg(n.alias("n_subjects"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def quality(readings: DataFrame) -> DataFrame:
    """Per subject of synchronised readings: records, share with glucose (percent), gaps above ten minutes and the longest, records
    with carbohydrates and with insulin; least, largest and mean glucose."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("subject_id").orderBy("us"))) / F.lit(float(schema.MINUTE_US))
    df = readings.withColumn("_gap", gap).groupBy("subject_id").agg(
        F.count("*").alias("n_records"),
        F.round(100.0 * F.count("glucose") / F.count("*"), 1).alias("cgm_availability_pct"),
        F.count_if(F.col("_gap") > 10).alias("n_gaps_over_10m"),
        F.coalesce(F.max(F.when(F.col("_gap") > 10, F.col("_gap"))), F.lit(0.0)).alias("max_gap_minutes"),
        F.count_if(F.col("carbohydrates") > 0).alias("meal_records"),
        F.count_if((F.col("bolus_insulin") > 0) | (F.col("basal_insulin") > 0)).alias("insulin_records"),
        F.min("glucose").alias("min_glucose"),
        F.max("glucose").alias("max_glucose"),
        F.avg("glucose").alias("mean_glucose"),
    )
    return df.withColumn("max_gap_minutes", F.round("max_gap_minutes", 1))
