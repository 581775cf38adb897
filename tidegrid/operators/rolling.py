"""Rolling totals over trailing days by event-contribution deltas.

Every daily amount is added at its date and subtracted after each window's length; the running sum
of these deltas over the calendar is the trailing total. Amounts are summed as whole millionths,
so nothing is left over when a window empties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import micros, value_or_null

DAY_US = 86_400_000_000
UNIT = 1_000_000
SIGNALS = ("glucose", "bolus", "carbs")


def usable(signal: str) -> Column:
    """The value where it is usable: glucose within [20, 600], amounts above zero."""
    value = value_or_null(signal)
    return F.when(value.between(20, 600) if signal == "glucose" else value > 0, value)


def daily_amounts(df: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Sum (millionths) and count of usable values per source and day; days with rows but no
    usable value have zeros. Of rows with one timestamp the lowest record_id counts. One exchange,
    by source and day, serves both steps, so a busy source is spread over its days."""
    us = micros("timestamp")
    rows = df.select("subject_id", us.alias("us"), "record_id", *signals).where(F.col("subject_id").isNotNull() & F.col("us").isNotNull())
    rows = rows.withColumn("day", F.floor(F.col("us") / F.lit(DAY_US)).cast("int")).repartition("subject_id", "day")
    order = F.coalesce("record_id", F.lit(2**63 - 1))
    first = rows.groupBy("subject_id", "day", "us").agg(*(F.min_by(F.col(s), order).alias(s) for s in signals))
    return first.groupBy("subject_id", "day").agg(
        *(x for s in signals for x in (F.coalesce(F.sum(F.round(usable(s) * UNIT).cast("bigint")), F.lit(0)).alias(f"{s}_sum"), F.count(usable(s)).alias(f"{s}_n")))
    )


def rolling_totals(df: DataFrame, periods: tuple[int, ...] = (7, 30), signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """One row per source and day from the date of its first row to that of its last.

    Columns: subject_id, day_utc ('YYYY-MM-DD') and for each signal and period {signal}_total_{p}d
    (0 if nothing was usable), {signal}_n_{p}d and {signal}_avg_{p}d (total over n, NULL if n is 0).
    Rows without source or time are left out; what lies before the first row counts as empty.
    Amounts are exact to a millionth. A source's rows after the daily sums are bounded by its calendar.
    """
    daily = daily_amounts(df, signals).repartition("subject_id")
    by_day = Window.partitionBy("subject_id").orderBy("day")
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    daily = daily.select("*", F.lead("day").over(by_day).alias("next_day"), F.max("day").over(whole).alias("last_day"))

    def moved(shift: int, sign: dict[int, int]) -> Column:
        fields = [(F.col("day") + shift).alias("day")]
        for p in periods:
            for s in signals:
                for kind in ("sum", "n"):
                    fields.append((F.col(f"{s}_{kind}") * F.lit(sign[p])).cast("bigint").alias(f"{s}_{kind}_{p}"))
        return F.struct(*fields)

    contributions = F.array(moved(0, dict.fromkeys(periods, 1)), *(moved(p, {x: -1 if x == p else 0 for x in periods}) for p in periods))
    names = [f"{s}_{kind}_{p}" for p in periods for s in signals for kind in ("sum", "n")]
    # days without rows up to the next day with some
    gap = F.when(F.col("next_day") > F.col("day") + 1, F.sequence(F.col("day") + 1, F.col("next_day") - 1))
    empty = F.transform(gap, lambda d: F.struct(d.alias("day"), *(F.lit(0).cast("bigint").alias(x) for x in names)))
    every = F.when(gap.isNull(), contributions).otherwise(F.concat(contributions, empty))
    deltas = daily.select("subject_id", "last_day", F.inline(every)).where(F.col("day") <= F.col("last_day")).drop("last_day")
    per_day = deltas.groupBy("subject_id", "day").agg(*(F.sum(x).alias(x) for x in names))
    running = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = per_day.select("subject_id", "day", *(F.sum(x).over(running).alias(x) for x in names))
    out = [F.col("subject_id"), F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day_utc")]
    for s in signals:
        for p in periods:
            total, n = F.col(f"{s}_sum_{p}") / F.lit(float(UNIT)), F.col(f"{s}_n_{p}")
            out += [total.alias(f"{s}_total_{p}d"), n.alias(f"{s}_n_{p}d"), F.when(n > 0, total / n).alias(f"{s}_avg_{p}d")]
    return totals.select(*out)


def empty_periods(totals: DataFrame, periods: tuple[int, ...] = (7, 30), signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Days whose trailing period holds no usable value of a signal."""
    cases = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(p).cast("bigint").alias("period_days"), F.col(f"{s}_n_{p}d").alias("n")) for s in signals for p in periods))
    return totals.select("subject_id", "day_utc", F.inline(F.filter(cases, lambda x: x["n"] == 0))).drop("n")
