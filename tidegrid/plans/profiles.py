"""Queries that profile canonical records and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators import profile
from tidegrid.plans.common import READINGS_SQL, readings, rounded
from tidegrid.session import table

#: Values that make a subject of the core cohort here; the operator's own defaults are for denser data.
CORE = {"days": 14, "cgm": 1000, "insulin": 1, "carbs": 1}
COLUMNS = ("subject_id", "timestamp", "glucose", "insulin", "basal", "bolus", "carbs", "steps", "heart_rate", "eda", "skin_temperature", "source_file")


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "canonical_records")


QUERIES = {
    "cohort_manifest": lambda s, d: profile.cohort(records(s, d)),
    "cohort_core": lambda s, d: profile.core(profile.cohort(records(s, d)), **CORE),
    "cohort_stats": lambda s, d: rounded(profile.cohort_stats(profile.cohort(records(s, d)), **CORE)),
    "profile_glucose": lambda s, d: rounded(profile.glucose_profile(records(s, d))),
    "profile_insulin": lambda s, d: profile.amount_profile(records(s, d)),
    "profile_carbs": lambda s, d: profile.carb_verdict(records(s, d)),
    "additivity_check": lambda s, d: profile.additivity(records(s, d)),
    "calendar_histogram": lambda s, d: profile.years(records(s, d)),
    "coverage_buckets": lambda s, d: profile.coverage(profile.cohort(records(s, d))),
    "null_audit": lambda s, d: rounded(profile.missing(records(s, d), COLUMNS)),
    "subjects_seen": lambda s, d: profile.subjects_seen(records(s, d)),
    "subjects_seen_approximate": lambda s, d: profile.subjects_seen(records(s, d), approximate=True),
    "data_quality_summary": lambda s, d: rounded(profile.quality(readings(s, d))),
}

_V = "CASE WHEN NOT isnan({0}) THEN {0} END"
_N = {v: _V.format(v) for v in ("glucose", "insulin", "basal", "bolus", "carbs")}
_MANIFEST = f"""manifest AS (
  SELECT subject_id, min("timestamp") AS first_ts, max("timestamp") AS last_ts, count({_N['glucose']}) AS cgm_rows, count({_N['insulin']}) AS insulin_rows, count({_N['carbs']}) AS carb_rows,
    date_diff('hour', min("timestamp"), max("timestamp")) AS duration_hours
  FROM canonical_records WHERE subject_id IS NOT NULL GROUP BY subject_id),
core AS (SELECT * FROM manifest WHERE duration_hours >= 336 AND cgm_rows >= 1000 AND insulin_rows >= 1 AND carb_rows >= 1)"""


def _amounts(c: str) -> str:
    return f"SELECT '{c}' AS column_name, count(v) AS n, count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v < 0) AS n_negative, count(*) FILTER (v > 0) AS n_positive, max(v) AS max_value FROM (SELECT {_V.format(c)} AS v FROM canonical_records)"


def _missing(c: str) -> str:
    none = f"{c} IS NULL OR isnan({c})" if c not in ("subject_id", "timestamp", "source_file") else f'"{c}" IS NULL'
    return f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({none}) AS n_missing, round(100.0 * count(*) FILTER ({none}) / count(*), 6) AS pct_missing FROM canonical_records"


SQL = {
    "cohort_manifest": f"WITH {_MANIFEST} SELECT * FROM manifest",
    "cohort_core": f"WITH {_MANIFEST} SELECT * FROM core",
    "cohort_stats": f"""WITH {_MANIFEST},
a AS (SELECT count(*) AS n_subjects, round(min(duration_hours / 24.0), 6) AS min_days, round(median(duration_hours / 24.0), 6) AS median_days, round(max(duration_hours / 24.0), 6) AS max_days FROM manifest),
b AS (SELECT count(*) AS n_core, round(median(duration_hours / 24.0), 6) AS core_median_days, round(CAST(median(cgm_rows) AS DOUBLE), 6) AS core_median_cgm_rows FROM core)
SELECT * FROM a CROSS JOIN b""",
    "profile_glucose": f"""SELECT count(g) AS n, min(g) AS min_glucose, max(g) AS max_glucose, round(avg(g), 6) AS mean_glucose, count(*) FILTER (g < 70) AS n_below_70, count(*) FILTER (g < 54) AS n_below_54,
round(100.0 * count(*) FILTER (g < 70) / count(g), 6) AS pct_below_70, round(100.0 * count(*) FILTER (g < 54) / count(g), 6) AS pct_below_54 FROM (SELECT {_N['glucose']} AS g FROM canonical_records)""",
    "profile_insulin": " UNION ALL ".join(map(_amounts, ("insulin", "basal", "bolus"))),
    "profile_carbs": f"SELECT *, CASE WHEN max_value > 1000 THEN 'cumulative' ELSE 'discrete' END AS verdict FROM ({_amounts('carbs')})",
    "additivity_check": f"""SELECT count(g) AS n, count(*) FILTER (g < 1e-4) AS n_within, count(*) FILTER (g <= 1e-5 + 1e-5 * abs(p)) AS n_close, count(*) FILTER (t = p) AS n_exact
FROM (SELECT t, p, abs(t - p) AS g FROM (SELECT {_N['insulin']} AS t, {_N['basal']} + {_N['bolus']} AS p FROM canonical_records))""",
    "calendar_histogram": 'SELECT year("timestamp") AS year, count(*) AS n FROM canonical_records WHERE "timestamp" IS NOT NULL GROUP BY 1',
    "coverage_buckets": f"WITH {_MANIFEST} SELECT count(*) AS n_subjects, " + ", ".join(f"count(*) FILTER (duration_hours >= {24 * d}) AS n_{d}d" for d in (1, 7, 14, 30)) + " FROM manifest",
    "null_audit": " UNION ALL ".join(map(_missing, COLUMNS)),
    "subjects_seen": 'SELECT count(DISTINCT subject_id) AS n_subjects, min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM canonical_records',
    "data_quality_summary": f"""WITH {READINGS_SQL},
g AS (SELECT *, (us - lag(us) OVER (PARTITION BY subject_id ORDER BY us)) / 60000000.0 AS gap FROM readings)
SELECT subject_id, count(*) AS n_records, round(100.0 * count(glucose) / count(*), 1) AS cgm_availability_pct, count(*) FILTER (gap > 10) AS n_gaps_over_10m, round(coalesce(max(gap) FILTER (gap > 10), 0), 1) AS max_gap_minutes,
  count(*) FILTER (carbohydrates > 0) AS meal_records, count(*) FILTER (bolus_insulin > 0 OR basal_insulin > 0) AS insulin_records, min(glucose) AS min_glucose, max(glucose) AS max_glucose, round(avg(glucose), 6) AS mean_glucose
FROM g GROUP BY subject_id""",
}
