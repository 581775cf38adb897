"""What the queries share: inputs, rounding, and the SQL of the synchronised readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.operators import features, metrics, sync, twin
from tidegrid.sources.adapters import stream_records


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """The four stream tables on five-minute slots."""
    return sync.synchronise(stream_records(spark, folder))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the rule-of-thumb score and the half-hour label, with the columns error tables need."""
    df = readings(spark, folder)
    have = [*df.columns, "is_night_clock_based"]
    df = features.layered(df, features.glucose_layers(have), features.insulin_layers(have), features.meal_layers(have), features.context_layers(), features.label_layers(have))
    df = df.withColumn("score", metrics.persistence()).withColumn("label", F.col("future_hypoglycemia_30m").cast("int"))
    return df.select("subject_id", "us", "score", "label", "glucose_current", "glucose_roc_5m", "is_night_clock_based", "bolus_insulin_recent", "insulin_bolus_last_30m", "carbs_recent", "carbs_last_30m", "minutes_since_last_glucose")


def twin_states(spark: SparkSession, folder: str) -> DataFrame:
    return twin.states(readings(spark, folder))


_COLUMNS = ", ".join(schema.SIGNALS)


def _part(stream: str) -> str:
    own = schema.VALUES[stream]
    values = ", ".join(f"CASE WHEN NOT isnan({v}) THEN {v} END AS {v}" if v in own else f"CAST(NULL AS DOUBLE) AS {v}" for v in schema.SIGNALS)
    return f"""SELECT patient_id AS subject_id, '{stream}' AS stream, {schema.STREAMS.index(stream)} AS rank, rec_id AS seq, epoch_us("timestamp") AS us, {values}
  FROM {stream}_records WHERE patient_id IS NOT NULL AND "timestamp" IS NOT NULL"""


RECORDS_SQL = "records AS (\n  " + "\n  UNION ALL ".join(_part(s) for s in schema.STREAMS) + ")"


def _first(v: str, name: str | None = None) -> str:
    return f"first({v} ORDER BY us, rank, seq) FILTER ({v} IS NOT NULL) AS {name or v}"


_WEAR = "struct_pack(" + ", ".join(f"{v} := {v}" for v in schema.VALUES["wearable"]) + ")"

READINGS_SQL = f"""{RECORDS_SQL},
slots AS (
  SELECT subject_id, us // 300000000 * 300000000 AS slot, {_first('glucose')}, {_first('basal_insulin')}, {_first('bolus_insulin')}, {_first('carbohydrates')},
    coalesce(first({_WEAR} ORDER BY us, rank, seq) FILTER (stream = 'wearable' AND heart_rate IS NOT NULL), last({_WEAR} ORDER BY us, rank, seq) FILTER (stream = 'wearable')) AS w
  FROM records GROUP BY ALL),
readings AS (
  SELECT subject_id, slot AS us, glucose, basal_insulin, bolus_insulin, carbohydrates, {', '.join(f'w.{v} AS {v}' for v in schema.VALUES['wearable'])} FROM slots)"""

FILLED_SQL = """around AS (
  SELECT *, row_number() OVER w AS n,
    last_value(glucose IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g0,
    last_value(CASE WHEN glucose IS NOT NULL THEN us END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
    first_value(glucose IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g1,
    first_value(CASE WHEN glucose IS NOT NULL THEN us END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
  FROM readings WINDOW w AS (PARTITION BY subject_id ORDER BY us)),
places AS (
  SELECT *, n - last_value(CASE WHEN glucose IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM around),
filled AS (
  SELECT * EXCLUDE (n, g0, t0, g1, t1, k), CAST(glucose IS NULL AS INTEGER) AS glucose_missing,
    CASE WHEN glucose IS NOT NULL THEN glucose WHEN k <= 2 THEN
      CASE WHEN g1 IS NOT NULL THEN g0 + (g1 - g0) * (us - t0) / (t1 - t0) ELSE g0 END END AS glucose_current
  FROM places)"""
CURRENT_SQL = f"{READINGS_SQL},\n{FILLED_SQL}"

#: Named windows over five-minute rows.
WINDOWS = "w AS (PARTITION BY subject_id ORDER BY us), " + ", ".join(f"w{m} AS (PARTITION BY subject_id ORDER BY us RANGE BETWEEN {m * 60_000_000 - 1} PRECEDING AND CURRENT ROW)" for m in (15, 30, 60, 1440)) + ", upto AS (PARTITION BY subject_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag_sql(minutes: int, column: str = "glucose_current") -> str:
    d = minutes * 60_000_000
    return f"first_value({column}) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN {d} PRECEDING AND {d} PRECEDING)"


def since_sql(condition: str) -> str:
    return f"(us - last_value(CASE WHEN {condition} THEN us END IGNORE NULLS) OVER upto) / 60000000.0"


NIGHT_SQL = "CAST((us // 3600000000) % 24 >= 22 OR (us // 3600000000) % 24 < 6 AS INTEGER)"

SCORED_SQL = f"""{CURRENT_SQL},
nexts AS (SELECT *, lead(glucose) OVER (PARTITION BY subject_id ORDER BY us) AS nx FROM filled),
contexts AS (
  SELECT subject_id, us, glucose_current, (glucose_current - {lag_sql(5)}) / 5 AS glucose_roc_5m, {NIGHT_SQL} AS is_night_clock_based,
    sum(coalesce(bolus_insulin, 0)) OVER w30 AS bolus_insulin_recent, sum(coalesce(carbohydrates, 0)) OVER w30 AS carbs_recent,
    {since_sql('glucose_current IS NOT NULL')} AS minutes_since_last_glucose,
    CAST(min(nx) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) < 70 AS INTEGER) AS label
  FROM nexts WINDOW {WINDOWS}),
scored AS (
  SELECT *, CASE WHEN glucose_current < 70 THEN 0.9 WHEN glucose_current < 85 AND glucose_roc_5m < -1 THEN 0.7 WHEN glucose_current < 85 AND glucose_roc_5m >= -1 AND glucose_roc_5m < 0 THEN 0.4 ELSE 0.0 END::DOUBLE AS score
  FROM contexts),
known AS (SELECT * FROM scored WHERE label IS NOT NULL)"""



def _states_sql(fitted: bool) -> str:
    """CTEs up to twin: the simulator's states, with the running baseline or, if fitted, with that of the whole history from the
    end of the burn-in on."""
    more = ", count(glucose) OVER (PARTITION BY subject_id) AS total, avg(glucose) OVER (PARTITION BY subject_id) AS mean" if fitted else ""
    burns = "least(10, total)" if fitted else "10"
    mean = "CASE WHEN max(total) >= 10 THEN max(mean) ELSE 110.0 END" if fitted else "list_sum(list(glucose ORDER BY us) FILTER (k <= 10 AND glucose IS NOT NULL)) / 10.0"
    enough = "max(k) >= 3 AND count(*) >= 10" if fitted else "max(k) >= 10"
    baseline = "b.burn_mean" if fitted else "coalesce(last_value(CASE WHEN c.us > b.burn_end AND k % 100 = 0 THEN s / k END IGNORE NULLS) OVER (PARTITION BY c.subject_id ORDER BY c.us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b.burn_mean)"
    return f"""{READINGS_SQL},
counted AS (
  SELECT subject_id, us, glucose, coalesce(basal_insulin, 0) AS basal, coalesce(bolus_insulin, 0) AS bolus, coalesce(carbohydrates, 0) AS carbs,
    count(glucose) OVER upto AS k, sum(glucose) OVER upto AS s{more} FROM readings WINDOW {WINDOWS}),
burns AS (
  SELECT subject_id, max(us) FILTER (k = {burns} AND glucose IS NOT NULL) AS burn_end, {mean} AS burn_mean
  FROM counted GROUP BY subject_id HAVING {enough}),
inputs AS (
  SELECT c.*, b.burn_end, b.burn_mean, row_number() OVER (PARTITION BY c.subject_id ORDER BY c.us) AS n, {baseline} AS baseline,
    (c.us - lag(c.us) OVER (PARTITION BY c.subject_id ORDER BY c.us)) / 60000000.0 AS minutes
  FROM counted c JOIN burns b USING (subject_id) WHERE c.us > b.burn_end OR c.glucose IS NOT NULL),
states(subject_id, us, n, glucose, insulin_action, insulin_state, meal_state, context_state, status, baseline, observed, missing_glucose, long_gap, emitted) AS (
  SELECT subject_id, us, n, glucose, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'not_calibrated', baseline, glucose, 0, 0, false FROM inputs WHERE n = 1
  UNION ALL
  SELECT i.subject_id, i.us, i.n,
    coalesce(i.glucose, greatest(10.0, s.glucose + 0.05 * (i.baseline - s.glucose) + 2.0 * (0.05 * s.meal_state) - 1.0 * s.insulin_action)),
    greatest(0.0, s.insulin_action - 0.1 * s.insulin_action + 0.1 * s.insulin_state),
    greatest(0.0, s.insulin_state - 0.1 * s.insulin_state + (i.bolus + i.basal * (i.minutes / 60.0))),
    greatest(0.0, s.meal_state - 0.05 * s.meal_state + i.carbs), s.context_state, s.status,
    i.baseline, i.glucose, CAST(i.glucose IS NULL AS INTEGER), CAST(i.minutes > 15 AND i.us > i.burn_end AS INTEGER), i.us {'>=' if fitted else '>'} i.burn_end
  FROM states s JOIN inputs i ON i.subject_id = s.subject_id AND i.n = s.n + 1),
twin AS (
  SELECT * EXCLUDE (n, emitted), list_concat(CASE WHEN missing_glucose = 1 THEN ['MISSING_GLUCOSE'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN long_gap = 1 THEN ['LONG_GAP'] ELSE CAST([] AS VARCHAR[]) END) AS flags
  FROM states WHERE emitted)"""


STATES_SQL = _states_sql(fitted=False)
FITTED_SQL = _states_sql(fitted=True)


def paths_sql(source: str, carbs: str = "0.0", bolus: str = "0.0", name: str = "paths", steps: int = 12) -> str:
    """Recursive CTE of simulated glucose: one row per step k of every row of source."""
    return f"""{name}(subject_id, us, scenario, k, g, a, i, m, baseline, c_kind, c_amount, c_offset) AS (
  SELECT subject_id, us, scenario, 0, glucose, insulin_action, insulin_state, meal_state, baseline, c_kind, c_amount, c_offset FROM {source}
  UNION ALL
  SELECT subject_id, us, scenario, k + 1, greatest(10.0, g + 0.05 * (baseline - g) + 2.0 * (0.05 * m) - 1.0 * a),
    greatest(0.0, a - 0.1 * a + 0.1 * i), greatest(0.0, i - 0.1 * i + {bolus}), greatest(0.0, m - 0.05 * m + {carbs}), baseline, c_kind, c_amount, c_offset
  FROM {name} WHERE k < {steps})"""
