"""Queries of the simulator: states, forecasts, features, what-if paths, forecast errors, and the models on top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.operators import features, joins, metrics, models, profile, splits, twin
from tidegrid.plans.common import CURRENT_SQL, FILLED_SQL, FITTED_SQL, SCORED_SQL, STATES_SQL, WINDOWS, lag_sql, paths_sql, readings, rounded, scored, twin_states
from tidegrid.session import checkpointed

SCENARIOS = [twin.meal(50.0, 15.0), twin.insulin(2.0, 10.0)]
GRID = [twin.meal(float(grams), 10.0) for grams in (20, 40, 60)] + [twin.insulin(float(units), 20.0) for units in (1, 3)]


def forecast_rows(spark: SparkSession, folder: str) -> DataFrame:
    d = twin.forecast(twin.latest(twin_states(spark, folder)))
    return rounded(d.select("subject_id", "us", F.posexplode("forecast").alias("k", "simulated")).select("subject_id", "us", ((F.col("k") + 1) * 5).alias("offset_minutes"), "simulated"))


def latest_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Per subject the latest state under the baseline of its history, the simulator's features there, and the quality of the data."""
    rows = checkpointed(readings(spark, folder))
    now = checkpointed(twin.latest(twin.fitted_states(rows)))  # one row a subject
    d = twin.twin_features(now).join(now.select("subject_id", "baseline"), "subject_id").join(profile.quality(rows).select("subject_id", "n_records", "cgm_availability_pct", "n_gaps_over_10m"), "subject_id")
    digits = {"baseline": 9}
    return d.select(*(F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes))


def _what_if(scenarios: list[twin.Scenario]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        d = rounded(twin.what_if_rows(twin.what_if(twin.latest(twin_states(spark, folder)), scenarios), digits=None))
        return d.withColumn("delta", F.round(F.col("scenario_glucose") - F.col("baseline_glucose"), 6))

    return query


def forecast_error_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the half-hour and one-hour forecasts against the reading at the row's own time."""
    return _errors(spark, folder, lambda minutes: F.col("observed"))


def forecast_error_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Errors against the reading exactly at the forecast's time, where there is one."""
    w = features.by_time()
    return _errors(spark, folder, lambda minutes: F.first("observed").over(w.rangeBetween(minutes * schema.MINUTE_US, minutes * schema.MINUTE_US)))


def _errors(spark: SparkSession, folder: str, observed) -> DataFrame:
    # every row after a burn-in has a state, so the readings to compare with are among the states' own
    d = twin_states(spark, folder).select("*", observed(30).alias("o30"), observed(60).alias("o60"))
    at = lambda m: F.get("forecast", F.lit(m // twin.STEP_MINUTES - 1))
    both = F.array(*(F.struct(F.lit(m).cast("bigint").alias("horizon"), at(m).alias("predicted"), F.col(f"o{m}").alias("observed")) for m in (30, 60)))
    d = twin.forecast(d)
    return rounded(metrics.forecast_error(d.select(F.inline(both)), "predicted", "observed", ["horizon"]))


def hybrid_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Features and labels joined with the simulator's features, with a split by subject."""
    rows = checkpointed(readings(spark, folder))  # features and simulator share the slots
    df = joins.with_features(features.hybrid_features(rows), twin.twin_features(twin.states(rows)))
    return splits.positional(df)


def hybrid_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid configuration's columns with NULL as 0, rows with a known half-hour label."""
    df = hybrid_frame(spark, folder).where(F.col("future_hypoglycemia_30m").isNotNull())
    names = models.features_of(df, "hybrid")
    digits = {"patient_glucose_baseline": 9}  # a mean of many readings can end in a tie at six
    exact = [F.round(c, digits.get(c, 6)).alias(c) if c != "hour_of_day" else F.col(c) for c in names]
    return df.fillna(0.0, names).select("subject_id", "us", *exact, "future_hypoglycemia_30m")


def model_abc(spark: SparkSession, folder: str) -> DataFrame:
    return models.compared(checkpointed(hybrid_frame(spark, folder)), "future_hypoglycemia_30m")


def _rows(spark: SparkSession, folder: str) -> tuple[list[str], DataFrame]:
    df = hybrid_frame(spark, folder)
    names = models.features_of(df, "hybrid")
    return names, checkpointed(models.prepared(df, names, "future_hypoglycemia_30m"))


def _model(spark: SparkSession, folder: str) -> tuple[object, list[str], DataFrame]:
    names, rows = _rows(spark, folder)
    return models.boosted(rows.where("split = 'train'"), names, stop=rows.where("split = 'validation'")), names, rows


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    model, names, _ = _model(spark, folder)
    return spark.createDataFrame(models.importances(model, names), "feature string, importance double")


def _calibrate(method):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        model, _, rows = _model(spark, folder)
        columns = ["subject_id", "us", "label", "score"]
        validation = models.scored(model, rows.where("split = 'validation'")).select(columns)
        return method(validation, models.scored(model, rows.where("split = 'test'")).select(columns))

    return query


def _risk(model, names: list[str], folder_frame: DataFrame, rows: DataFrame) -> DataFrame:
    """(subject_id, us, risk): the model's score of every subject's latest state under the baseline of its history, with the plain features of its latest row."""
    now = twin.twin_features(twin.latest(twin.fitted_states(rows)))
    plain = twin.latest(folder_frame.select("subject_id", "us", *(c for c in names if c not in models.TWIN)))
    both = now.join(plain.drop("us"), "subject_id", "left").fillna(0.0, names)
    return models.scored(model, both).select("subject_id", "us", F.col("score").alias("risk"))


def latest_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk of low glucose within the half hour of every subject's latest state, by a model of all train rows."""
    model, names, _ = _model(spark, folder)
    return _risk(model, names, hybrid_frame(spark, folder), checkpointed(readings(spark, folder)))


def model_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of one whole model and what is built on it: (check, n rows or features concerned, holds)."""
    model, names, rows = _model(spark, folder)
    columns = ["subject_id", "us", "label", "score"]
    validation = checkpointed(models.scored(model, rows.where("split = 'validation'")).select(columns))
    test = checkpointed(models.scored(model, rows.where("split = 'test'")).select(columns))
    share = lambda c: F.coalesce(F.min(F.col(c).between(0, 1)), F.lit(True))
    checks = [test.agg(F.count("*").alias("n"), share("score").alias("holds")).select(F.lit("scores").alias("check"), "*")]
    for name, method in (("isotonic", models.isotonic), ("platt", models.platt), ("by_size", models.calibrated)):
        checks.append(method(validation, test).agg(F.count("calibrated").alias("n"), share("calibrated").alias("holds")).select(F.lit(name).alias("check"), "*"))
    # a monotone map keeps the order of scores
    w = Window.partitionBy(F.floor(F.col("score") * 50)).orderBy("score", "calibrated")
    ordered = models.isotonic(validation, test).select((F.col("calibrated") >= F.coalesce(F.lag("calibrated").over(w), F.col("calibrated"))).alias("up"), "calibrated")
    checks.append(ordered.agg(F.count("calibrated").alias("n"), F.min("up").alias("holds")).select(F.lit("monotone").alias("check"), "*"))
    risk = _risk(model, names, hybrid_frame(spark, folder), checkpointed(readings(spark, folder)))
    checks.append(risk.agg(F.count("risk").alias("n"), share("risk").alias("holds")).select(F.lit("risk").alias("check"), "*"))
    importance = models.importances(model, names)
    falling = all(a[1] >= b[1] for a, b in zip(importance, importance[1:])) and abs(sum(x for _, x in importance) - 1) < 1e-6
    checks.append(spark.createDataFrame([("importance", len(importance), falling)], "check string, n bigint, holds boolean"))
    return reduce(DataFrame.unionByName, checks)


def twin_features_at(spark: SparkSession, folder: str) -> DataFrame:
    """The simulator's features at the full hours only."""
    state = twin_states(spark, folder)
    return rounded(twin.twin_features(twin.at_times(state, readings(spark, folder).where(F.col("us") % 3_600_000_000 == 0).select("subject_id", "us"))))


def ensemble_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, percentiles and deviation of eleven members' scores, which are here powers of the rule-of-thumb score."""
    member = F.explode(F.sequence(F.lit(1), F.lit(11))).alias("member")
    rows = scored(spark, folder).where(F.col("score") > 0).select("subject_id", "us", "score", member).withColumn("score", F.pow("score", F.col("member")))
    return rounded(metrics.ensemble_stats(rows, ["subject_id", "us"]), 9)


def bootstrap_uncertainty(spark: SparkSession, folder: str) -> DataFrame:
    names, rows = _rows(spark, folder)
    return models.bootstrap(rows.where("split = 'train'"), rows.where("split = 'test'"), names)


QUERIES = {
    "twin_states": lambda s, d: rounded(twin_states(s, d).withColumn("flags", F.array_join("flags", ","))),
    "twin_forecast": forecast_rows,
    "twin_features": lambda s, d: rounded(twin.twin_features(twin_states(s, d))),
    "latest_inference": latest_inference,
    "whatif_meal": _what_if(SCENARIOS[:1]),
    "whatif_insulin": _what_if(SCENARIOS[1:]),
    "whatif_grid": _what_if(GRID),
    "forecast_error_parity": forecast_error_parity,
    "forecast_error_strict": forecast_error_strict,
    "hybrid_matrix": hybrid_matrix,
    "model_abc": model_abc,
    "feature_importance": feature_importance,
    "calibrate_isotonic": _calibrate(models.isotonic),
    "calibrate_platt": _calibrate(models.platt),
    "bootstrap_uncertainty": bootstrap_uncertainty,
    "latest_risk": latest_risk,
    "model_checks": model_checks,
    "twin_features_at": twin_features_at,
    "ensemble_stats": ensemble_stats,
}

_LATEST = "latest AS (SELECT * FROM twin QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY us DESC) = 1)"
_PLAIN = "SELECT *, '' AS scenario, '' AS c_kind, 0.0::DOUBLE AS c_amount, 0.0::DOUBLE AS c_offset FROM {0}"
_FEATURES = f"""starts AS ({_PLAIN.format('twin')}),
{paths_sql('starts')},
wide AS (SELECT subject_id, us, max(g) FILTER (k = 1) AS g5, max(g) FILTER (k = 3) AS g15, max(g) FILTER (k = 6) AS g30, max(g) FILTER (k = 12) AS g60 FROM paths GROUP BY subject_id, us)"""


def _scenarios(scenarios: list[twin.Scenario]) -> str:
    rows = ", ".join(f"('{s.description}', '{s.kind}', {s.amount}::DOUBLE, {s.offset_minutes}::DOUBLE)" for s in scenarios)
    given = lambda kind: f"CASE WHEN c_kind = '{kind}' AND abs((k + 1) * 5 - c_offset) < 2.5 THEN c_amount ELSE 0.0 END"
    return f"""WITH RECURSIVE {STATES_SQL}, {_LATEST},
scenarios(scenario, c_kind, c_amount, c_offset) AS (VALUES {rows}),
starts AS (SELECT * FROM latest CROSS JOIN scenarios),
{paths_sql('starts')},
{paths_sql('starts', given('meal_perturbation'), given('insulin_timing'), 'changed')}
SELECT c.subject_id, c.us, c.scenario, CAST(c.k * 5 AS INTEGER) AS offset_minutes, round(p.g, 6) AS baseline_glucose, round(c.g, 6) AS scenario_glucose, round(round(c.g, 6) - round(p.g, 6), 6) AS delta
FROM changed c JOIN paths p USING (subject_id, us, scenario, k) WHERE c.k > 0"""


def _error_sql(observed: str) -> str:
    one = lambda m: f"""SELECT {m}::BIGINT AS horizon, count(e) AS n_valid, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(median(abs(e)), 6) AS median_ae, round(avg(e), 6) AS bias
FROM (SELECT g{m} - {observed.format(m=m)} AS e FROM wide w JOIN readings r ON r.subject_id = w.subject_id AND r.us = w.us LEFT JOIN readings l ON l.subject_id = w.subject_id AND l.us = w.us + {m * 60_000_000})"""  # noqa: E731
    return f"WITH RECURSIVE {STATES_SQL}, {_FEATURES} {one(30)} UNION ALL {one(60)}"


_TWIN_COLUMNS = """round(t.glucose, 6) AS twin_glucose_current, round(insulin_action, 6) AS twin_insulin_action, round(insulin_state, 6) AS twin_insulin_state, round(meal_state, 6) AS twin_meal_state, context_state AS twin_context_state,
  round(g5, 6) AS twin_glucose_t5, round(g15, 6) AS twin_glucose_t15, round(g30, 6) AS twin_glucose_t30, round(g60, 6) AS twin_glucose_t60, round((g30 - t.glucose) / 30, 6) AS twin_slope_30m, round((g60 - t.glucose) / 60, 6) AS twin_slope_60m,
  round(g15 - t.glucose, 6) AS twin_delta_15m, round(g30 - t.glucose, 6) AS twin_delta_30m, round(g60 - t.glucose, 6) AS twin_delta_60m, round(observed - t.glucose, 6) AS twin_residual_current,
  list_contains(flags, 'LONG_GAP')::INTEGER::DOUBLE AS twin_has_long_gap, list_contains(flags, 'MISSING_GLUCOSE')::INTEGER::DOUBLE AS twin_has_missing_glucose, (status = 'calibrated')::INTEGER::DOUBLE AS twin_uncertainty_calibrated"""

#: Plain features of the hybrid configuration that the slots give.
_HYBRID_COLUMNS = {"glucose_current", "glucose_roc_5m", "glucose_roc_15m", "glucose_roc_30m", "patient_glucose_baseline", "hour_of_day", *models.TWIN}

_HYBRID = f"""WITH RECURSIVE {STATES_SQL}, {FILLED_SQL}, {_FEATURES},
base AS (
  SELECT subject_id, us, glucose_current, {', '.join(f'(glucose_current - {lag_sql(m)}) / {m} AS glucose_roc_{m}m' for m in (5, 15, 30))},
    avg(glucose) OVER w1440 AS patient_glucose_baseline, CAST((us // 3600000000) % 24 AS INTEGER) AS hour_of_day, lead(glucose) OVER w AS nx FROM filled WINDOW {WINDOWS}),
labels AS (SELECT *, CAST(min(nx) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) < 70 AS DOUBLE) AS label FROM base),
twins AS (SELECT t.subject_id, t.us, {_TWIN_COLUMNS} FROM twin t JOIN wide USING (subject_id, us))
SELECT b.subject_id, b.us, {', '.join(f'round(coalesce({c}, 0), {d}) AS {c}' for c, d in (('glucose_current', 6), ('glucose_roc_5m', 6), ('glucose_roc_15m', 6), ('glucose_roc_30m', 6), ('patient_glucose_baseline', 9)))}, hour_of_day,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in models.TWIN)}, label AS future_hypoglycemia_30m
FROM labels b LEFT JOIN twins USING (subject_id, us) WHERE label IS NOT NULL"""

SQL = {
    "model_checks": f"""WITH {CURRENT_SQL},
nexts AS (SELECT subject_id, us, lead(glucose) OVER (PARTITION BY subject_id ORDER BY us) AS nx, row_number() OVER (PARTITION BY subject_id ORDER BY us) > floor(count(*) OVER (PARTITION BY subject_id) * 0.8::DOUBLE) AS test FROM filled),
t AS (SELECT test, min(nx) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) AS least FROM nexts),
n AS (SELECT count(*) FILTER (test AND least IS NOT NULL) AS n FROM t),
s AS (SELECT count(*) AS n FROM (SELECT subject_id FROM readings GROUP BY subject_id HAVING count(*) >= 10 AND count(glucose) >= 3))
SELECT "check", n, true AS holds FROM n, (VALUES ('scores'), ('isotonic'), ('platt'), ('by_size'), ('monotone')) c("check")
UNION ALL SELECT 'risk', n, true FROM s UNION ALL SELECT 'importance', {len([c for c in models.CONFIGURATIONS['hybrid'] if c in _HYBRID_COLUMNS])}, true""",
    "twin_features_at": f"WITH RECURSIVE {STATES_SQL}, {_FEATURES} SELECT t.subject_id, t.us, {_TWIN_COLUMNS} FROM twin t JOIN wide USING (subject_id, us) WHERE t.us % 3600000000 = 0",
    "ensemble_stats": f"""WITH {SCORED_SQL}, m AS (SELECT subject_id, us, pow(score, i) AS s FROM scored, range(1, 12) r(i) WHERE score > 0)
SELECT subject_id, us, round(avg(s), 9) AS mean_prob, round(quantile_cont(s, 0.05), 9) AS lower_5pct, round(quantile_cont(s, 0.95), 9) AS upper_95pct, round(stddev_pop(s), 9) AS std FROM m GROUP BY ALL""",
    "hybrid_matrix": _HYBRID,
    "twin_states": f"WITH RECURSIVE {STATES_SQL} SELECT subject_id, us, round(glucose, 6) AS glucose, round(insulin_action, 6) AS insulin_action, round(insulin_state, 6) AS insulin_state, round(meal_state, 6) AS meal_state, round(baseline, 6) AS baseline, round(observed, 6) AS observed, missing_glucose, long_gap, context_state, array_to_string(flags, ',') AS flags, status FROM twin",
    "twin_forecast": f"WITH RECURSIVE {STATES_SQL}, {_LATEST}, starts AS ({_PLAIN.format('latest')}), {paths_sql('starts')} SELECT subject_id, us, CAST(k * 5 AS INTEGER) AS offset_minutes, round(g, 6) AS simulated FROM paths WHERE k > 0",
    "twin_features": f"WITH RECURSIVE {STATES_SQL}, {_FEATURES} SELECT t.subject_id, t.us, {_TWIN_COLUMNS} FROM twin t JOIN wide USING (subject_id, us)",
    "latest_inference": f"""WITH RECURSIVE {FITTED_SQL}, {_LATEST}, starts AS ({_PLAIN.format('latest')}),
{_FEATURES.partition(chr(10))[2]},
q AS (SELECT subject_id, count(*) AS n_records, round(100.0 * count(glucose) / count(*), 1) AS cgm_availability_pct, count(*) FILTER (gap > 10) AS n_gaps_over_10m
  FROM (SELECT *, (us - lag(us) OVER (PARTITION BY subject_id ORDER BY us)) / 60000000.0 AS gap FROM readings) GROUP BY subject_id)
SELECT t.subject_id, t.us, {_TWIN_COLUMNS}, round(baseline, 9) AS baseline, n_records, cgm_availability_pct, n_gaps_over_10m FROM latest t JOIN wide USING (subject_id, us) JOIN q USING (subject_id)""",
    "whatif_meal": _scenarios(SCENARIOS[:1]),
    "whatif_insulin": _scenarios(SCENARIOS[1:]),
    "whatif_grid": _scenarios(GRID),
    "forecast_error_parity": _error_sql("r.glucose"),
    "forecast_error_strict": _error_sql("l.glucose"),
}
