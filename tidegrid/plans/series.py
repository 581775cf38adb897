"""Queries on the subjects' records: regular grid, rolling totals, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import gridding, rolling, spikes
from tidegrid.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.missing_runs(table(spark, folder, "canonical_records"))


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.regular_grid(table(spark, folder, "canonical_records"))


def p1_marks(spark: SparkSession, folder: str) -> DataFrame:
    """What the grid counts and marks: every column that doesn't come from the smoother."""
    return gridding.regular_grid(table(spark, folder, "canonical_records")).select("subject_id", "slot_start_us", "n_readings", "missing", "gap_slots")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.empty_periods(rolling.rolling_totals(table(spark, folder, "canonical_records")))


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, folder, "canonical_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "canonical_records"))


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.score_readings(table(spark, folder, "canonical_records"))


def p3_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that the limit rule flags, among the scores of all."""
    return spikes.score_readings(table(spark, folder, "canonical_records"), only_flagged=True).where(F.col("rule") == "impossible").select("record_id", "signal", "value")


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_marks": p1_marks, "p2_found": p2_found, "p2_rolling": p2_rolling, "p3_found": p3_found, "p3_scores": p3_scores, "p3_limits": p3_limits}

_FIRST_ROWS = """
first_rows AS (
  SELECT subject_id, epoch_us("timestamp") // 86400000000 AS d,
    CASE WHEN NOT isnan(glucose) AND glucose BETWEEN 20 AND 600 THEN glucose END AS glucose,
    CASE WHEN NOT isnan(bolus) AND bolus > 0 THEN bolus END AS bolus,
    CASE WHEN NOT isnan(carbs) AND carbs > 0 THEN carbs END AS carbs
  FROM canonical_records WHERE subject_id IS NOT NULL AND "timestamp" IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY subject_id, "timestamp" ORDER BY record_id) = 1),
days AS (
  SELECT subject_id, unnest(range(min(d), max(d) + 1)) AS d FROM first_rows GROUP BY subject_id),
sums AS (
  SELECT c.subject_id, c.d,
    sum(f.glucose) FILTER (f.d > c.d - 7) AS g7, count(f.glucose) FILTER (f.d > c.d - 7) AS gn7,
    sum(f.glucose) AS g30, count(f.glucose) AS gn30,
    sum(f.bolus) FILTER (f.d > c.d - 7) AS b7, count(f.bolus) FILTER (f.d > c.d - 7) AS bn7,
    sum(f.bolus) AS b30, count(f.bolus) AS bn30,
    sum(f.carbs) FILTER (f.d > c.d - 7) AS c7, count(f.carbs) FILTER (f.d > c.d - 7) AS cn7,
    sum(f.carbs) AS c30, count(f.carbs) AS cn30
  FROM days c LEFT JOIN first_rows f ON f.subject_id = c.subject_id AND f.d BETWEEN c.d - 29 AND c.d
  GROUP BY c.subject_id, c.d)
"""



def _limits_sql(signal: str) -> str:
    low, high = spikes.SIGNALS[signal]["limits"]
    a, b, factor, offset = spikes.SIGNALS[signal]["other"]
    return f"""
SELECT record_id, '{signal}' AS signal, {signal} AS value
FROM (SELECT record_id, {signal}, quantile_disc(CASE WHEN nth = 1 THEN {signal} END, 0.5) OVER (PARTITION BY subject_id) BETWEEN {a} AND {b} AS other
  FROM (SELECT record_id, subject_id, {signal}, row_number() OVER (PARTITION BY subject_id, "timestamp" ORDER BY record_id) AS nth
    FROM canonical_records WHERE subject_id IS NOT NULL AND "timestamp" IS NOT NULL AND NOT isnan({signal})))
WHERE NOT (CASE WHEN other THEN {signal} * {factor!r} + {offset!r} ELSE {signal} END BETWEEN {low} AND {high})"""


SQL = {
    "p1_marks": """
WITH s AS (
  SELECT subject_id, epoch_us("timestamp") // 300000000 AS slot, count(*) AS n FROM canonical_records
  WHERE subject_id IS NOT NULL AND NOT isnan(glucose) AND glucose BETWEEN 20 AND 600 GROUP BY ALL),
g AS (SELECT subject_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM s GROUP BY subject_id),
m AS (
  SELECT subject_id, slot, n, max(slot) FILTER (n > 0) OVER w AS before,
    min(slot) FILTER (n > 0) OVER (PARTITION BY subject_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM g LEFT JOIN s USING (subject_id, slot) WINDOW w AS (PARTITION BY subject_id ORDER BY slot))
SELECT subject_id, slot * 300000000 AS slot_start_us, coalesce(n, 0) AS n_readings, n IS NULL AS missing,
  CASE WHEN n IS NULL THEN after - before - 1 ELSE 0 END AS gap_slots FROM m""",
    "p3_limits": " UNION ALL ".join(map(_limits_sql, spikes.SIGNALS)),
    "p1_found": """
WITH s AS (
  SELECT DISTINCT subject_id, epoch_us("timestamp") // 300000000 AS slot FROM canonical_records
  WHERE subject_id IS NOT NULL AND NOT isnan(glucose) AND glucose BETWEEN 20 AND 600),
n AS (SELECT subject_id, slot, lead(slot) OVER (PARTITION BY subject_id ORDER BY slot) AS after FROM s)
SELECT subject_id, (slot + 1) * 300000000 AS gap_start_us, (after - 1) * 300000000 AS gap_end_us
FROM n WHERE after - slot - 1 >= 6""",
    "p2_found": f"""
WITH {_FIRST_ROWS},
cases AS (
  SELECT subject_id, d, 'glucose' AS signal, 7 AS period_days, gn7 AS n FROM sums
  UNION ALL SELECT subject_id, d, 'glucose', 30, gn30 FROM sums
  UNION ALL SELECT subject_id, d, 'bolus', 7, bn7 FROM sums
  UNION ALL SELECT subject_id, d, 'bolus', 30, bn30 FROM sums
  UNION ALL SELECT subject_id, d, 'carbs', 7, cn7 FROM sums
  UNION ALL SELECT subject_id, d, 'carbs', 30, cn30 FROM sums)
SELECT subject_id, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day_utc, signal,
  CAST(period_days AS BIGINT) AS period_days
FROM cases WHERE n = 0""",
    "p2_rolling": f"""
WITH {_FIRST_ROWS}
SELECT subject_id, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day_utc,
  round(coalesce(g7, 0), 6) AS glucose_total_7d, gn7 AS glucose_n_7d, round(g7, 6) / gn7 AS glucose_avg_7d,
  round(coalesce(g30, 0), 6) AS glucose_total_30d, gn30 AS glucose_n_30d, round(g30, 6) / gn30 AS glucose_avg_30d,
  round(coalesce(b7, 0), 6) AS bolus_total_7d, bn7 AS bolus_n_7d, round(b7, 6) / bn7 AS bolus_avg_7d,
  round(coalesce(b30, 0), 6) AS bolus_total_30d, bn30 AS bolus_n_30d, round(b30, 6) / bn30 AS bolus_avg_30d,
  round(coalesce(c7, 0), 6) AS carbs_total_7d, cn7 AS carbs_n_7d, round(c7, 6) / cn7 AS carbs_avg_7d,
  round(coalesce(c30, 0), 6) AS carbs_total_30d, cn30 AS carbs_n_30d, round(c30, 6) / cn30 AS carbs_avg_30d
FROM sums""",
}
