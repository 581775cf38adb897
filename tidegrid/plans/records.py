"""Queries on synchronised readings: slots, quality, features, labels and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.operators import features, joins, profile, splits, sync
from tidegrid.plans.common import CURRENT_SQL, NIGHT_SQL, READINGS_SQL, RECORDS_SQL, WINDOWS, lag_sql, readings, rounded, since_sql
from tidegrid.session import checkpointed, table, with_row
from tidegrid.sources import adapters, parquet


def of_readings(step: Callable[[DataFrame], DataFrame], columns: str, digits: int = 6):
    """A query that keeps some columns of a step over the readings."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(step(readings(spark, folder)).select("subject_id", "us", *columns.split()), digits)

    return query


def quality_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.stream(table(spark, folder, "cgm_records"), "cgm").select("subject_id", "us", "seq", "glucose")
    return sync.plausible(sync.without_negatives(sync.first_of_each_time(rows)))


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return sync.validation(adapters.stream_records(spark, folder))


def validity(spark: SparkSession, folder: str) -> DataFrame:
    return sync.validity(adapters.stream_records(spark, folder))


def stream_report(spark: SparkSession, folder: str) -> DataFrame:
    return sync.stream_report(adapters.stream_records(spark, folder))


def labelled(df: DataFrame, strict: bool = False) -> DataFrame:
    return features.with_labels(features.context_features(df), strict=strict)


def window_trim(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled(readings(spark, folder))
    return features.trimmed(df, ["future_hypoglycemia_30m", "future_hypoglycemia_60m"]).select("subject_id", "us", "glucose", "future_hypoglycemia_30m", "future_hypoglycemia_60m")


def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature and label of plausible rows of large enough subjects, as the training matrix has them."""
    df = features.all_features(sync.plausible(sync.without_negatives(readings(spark, folder))))
    return rounded(features.large_enough(df, ["future_hypoglycemia_30m", "future_hypoglycemia_60m"]), 9)


def split_two_way(spark: SparkSession, folder: str) -> DataFrame:
    return splits.two_way(readings(spark, folder)).select("subject_id", "us", "split")


def split_positional(spark: SparkSession, folder: str) -> DataFrame:
    return splits.positional(readings(spark, folder)).select("subject_id", "us", "split")


def split_embargo(spark: SparkSession, folder: str) -> DataFrame:
    return splits.with_embargo(readings(spark, folder)).select("subject_id", "us", "split")


def split_leak_audit(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leak_audit(split_embargo(spark, folder))


def split_subject_hash(spark: SparkSession, folder: str) -> DataFrame:
    return splits.subject_hash(readings(spark, folder).select("subject_id").distinct())


def union_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of an embargo split put together again, counted by split and subject."""
    parts = split_embargo(spark, folder)
    whole = parts.where("split = 'train'").unionByName(parts.where("split = 'validation'")).unionByName(parts.where("split = 'test'"))
    return whole.groupBy("subject_id", "split").agg(F.count("*").alias("n"))


def subject_semijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical records (projected) of the subjects that the stream tables cover."""
    ids = table(spark, folder, "cgm_records").select(F.col("patient_id").alias("subject_id")).where(F.col("subject_id").isNotNull())
    return adapters.of_subjects(table(spark, folder, "canonical_records").select("subject_id", "record_id"), ids)


def canonical_adapter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "canonical_records").withColumnsRenamed({"subject_id": "id", "timestamp": "date", "glucose": "CGM", "heart_rate": "heartrate", "eda": "galvanic_skin_response", "skin_temperature": "skin_temp"})
    return adapters.canonical(rows)


def semantic_columns(spark: SparkSession, folder: str) -> DataFrame:
    return parquet.semantic_columns(table(spark, folder, "canonical_records"))


def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    """Meals and insulin records side by side, each in the order of their ids."""
    part = lambda name, *columns: table(spark, folder, name).select(F.col("rec_id").alias(f"{name[:4]}_id"), *columns)
    return joins.side_by_side(part("meal_records", "carbohydrates"), part("insulin_records", "bolus_insulin"), ("meal_id",), ("insu_id",))


def split_routed(spark: SparkSession, folder: str) -> DataFrame:
    """Slots routed by a table that knows the subjects with a meal on record only."""
    known = adapters.stream(table(spark, folder, "meal_records"), "meal").select("subject_id").distinct()
    return splits.routed(readings(spark, folder).select("subject_id", "us"), splits.subject_hash(known))


def lag_and_last(spark: SparkSession, folder: str) -> DataFrame:
    d = readings(spark, folder).select("subject_id", "us", joins.at_lag("glucose", 10).alias("glucose_10m_ago"), joins.last_time(F.col("glucose") < schema.LOW).alias("last_low_us"))
    return rounded(d)


def sanitised_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features that may be infinite, with a label, sanitised."""
    df = labelled(features.glucose_features(readings(spark, folder)))
    steep = F.when(F.col("glucose_roc_5m") != 0, 1 / F.col("glucose_roc_5m")).when(F.col("glucose_roc_5m") == 0, F.lit(float("inf")))
    df = df.withColumn("minutes_per_unit", steep).select("subject_id", "us", "glucose_current", "minutes_per_unit", "is_night_clock_based", F.lit("x").alias("patient_id"), "future_hypoglycemia_30m", "future_hypoglycemia_60m")
    return rounded(features.sanitised(df, "future_hypoglycemia_30m")[1])


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects in each part of the drawn splits of subjects: 60/20/20, and 70/15/15 with its own validation size."""
    ids = [r[0] for r in readings(spark, folder).select("subject_id").distinct().collect()]
    rows = []
    for kind, drawn in (("60/20/20", splits.subject_permutation(ids)), ("70/15/15", splits.subject_permutation(ids, 0.7, 0.15, separate=True))):
        rows += [(kind, part, sum(v == part for v in drawn.values())) for part in ("train", "validation", "test")]
    return spark.createDataFrame(rows, "kind string, split string, n bigint")


def sample_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty subjects drawn without replacement, in two ways: how many, how many different ones, and how many of them are known."""
    ids = readings(spark, folder).select("subject_id").distinct()
    drawn = splits.subject_draw([r[0] for r in ids.collect()], 50)
    both = splits.sample_subjects(ids, 50).select(F.lit("hash").alias("kind"), "subject_id").unionByName(spark.createDataFrame([("seeded", s) for s in drawn], "kind string, subject_id string"))
    marked = both.join(ids.withColumn("known", F.lit(1)), "subject_id", "left")
    return marked.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_different"), F.count("known").alias("n_known"))


def bootstrap_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Ten resamples with replacement: whether each has about as many rows as there are, about 63 % of the rows at least once, and others more than once."""
    rows = checkpointed(readings(spark, folder).select("subject_id", "us"))
    total = rows.agg(F.count("*").alias("n_rows"))
    each = None
    for member in range(10):
        times = splits.resampled(rows, member).groupBy("subject_id", "us").agg(F.count("*").alias("k"))
        part = times.agg(F.sum("k").alias("drawn"), F.count("*").alias("met"), F.max("k").alias("most")).select(F.lit(member).alias("member"), "*")
        each = part if each is None else each.unionByName(part)
    share = lambda c, want, off: (F.abs(F.col(c) / F.col("n_rows") - want) < off)
    return with_row(each, total).select("member", "n_rows", share("drawn", 1.0, 0.1).alias("near"), share("met", 0.632, 0.07).alias("with_repeats"), (F.col("most") > 1).alias("several_times"))


def shuffled_train(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every train row in the shuffled order."""
    rows = splits.two_way(readings(spark, folder)).where("split = 'train'").select("subject_id", "us", splits.shuffle_key().alias("key"))
    return joins.numbered(rows, "key", "subject_id", "us").select("subject_id", "us", F.col("_row").alias("place"))


def top_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """The ten subjects with the most canonical records (a top-k report)."""
    return profile.top(table(spark, folder, "canonical_records").where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(F.count("*").alias("n")), "n", 10)


STATS = "mean std min max"
QUERIES = {
    "sync_readings": of_readings(lambda d: d, " ".join(schema.SIGNALS)),
    "quality_dedup": quality_dedup,
    "validation_report": validation_report,
    "validity": validity,
    "stream_report": stream_report,
    "context_features": of_readings(features.context_features, "hour_of_day minute_of_day day_of_week is_night_clock_based"),
    "cgm_interpolate": of_readings(features.glucose_features, "glucose_missing glucose_current glucose_interpolated minutes_since_last_glucose"),
    "cgm_lag_roc": of_readings(features.glucose_features, "glucose_delta_5m glucose_delta_15m glucose_roc_5m glucose_roc_15m glucose_roc_30m"),
    "cgm_rolling_30m": of_readings(features.glucose_features, " ".join(f"glucose_rolling_{s}_30m" for s in STATS.split()), 9),
    "cgm_rolling_60m": of_readings(features.glucose_features, " ".join(f"glucose_rolling_{s}_60m" for s in STATS.split()), 9),
    "insulin_features": of_readings(features.insulin_features, "insulin_bolus_last_15m insulin_bolus_last_30m insulin_bolus_last_60m minutes_since_bolus basal_current"),
    "meal_features": of_readings(features.meal_features, "carbs_last_30m carbs_last_60m minutes_since_meal"),
    "wearable_features": of_readings(features.wearable_features, "hr_current hr_rolling_mean_30m hr_rolling_std_30m eda_current eda_rolling_mean_30m temp_current temp_rolling_mean_30m acc_magnitude acc_rolling_mean_15m acc_rolling_std_15m"),
    "baseline_24h": of_readings(features.baseline_features, "personal_glucose_baseline_24h personal_glucose_std_24h glucose_deviation_from_baseline patient_glucose_std personal_hr_baseline_24h", 9),
    "labels_30m": of_readings(labelled, "future_hypoglycemia_30m"),
    "labels_60m": of_readings(labelled, "future_hypoglycemia_60m"),
    "labels_severe": of_readings(labelled, "future_severe_hypoglycemia_30m future_severe_hypoglycemia_60m"),
    "labels_nocturnal": of_readings(labelled, "future_nocturnal_hypoglycemia_30m future_nocturnal_hypoglycemia_60m"),
    "labels_strict": of_readings(lambda d: labelled(d, True), "future_hypoglycemia_30m future_hypoglycemia_60m"),
    "window_trim": window_trim,
    "feature_matrix": feature_matrix,
    "split_two_way": split_two_way,
    "split_positional": split_positional,
    "split_embargo": split_embargo,
    "split_leak_audit": split_leak_audit,
    "split_subject_hash": split_subject_hash,
    "union_splits": union_splits,
    "subject_semijoin": subject_semijoin,
    "canonical_adapter": canonical_adapter,
    "semantic_columns": semantic_columns,
    "positional_join": positional_join,
    "split_routed": split_routed,
    "lag_and_last": lag_and_last,
    "sanitised_features": sanitised_features,
    "split_sizes": split_sizes,
    "sample_subjects": sample_subjects,
    "bootstrap_sizes": bootstrap_sizes,
    "shuffled_train": shuffled_train,
    "top_subjects": top_subjects,
}


def _rolling(m: int) -> str:
    f = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return f"WITH {CURRENT_SQL} SELECT subject_id, us, " + ", ".join(f"round({f[s]}(glucose_current) OVER w{m}, 9) AS glucose_rolling_{s}_{m}m" for s in STATS.split()) + f" FROM filled WINDOW {WINDOWS}"


def _labels(columns: dict[str, str], strict: bool = False) -> str:
    least = {m: f"min({'glucose' if strict else 'nx'}) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN {'1 FOLLOWING' if strict else 'CURRENT ROW'} AND {m * 60_000_000 - (not strict)} FOLLOWING) AS m{m}" for m in (30, 60)}
    out = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items())
    return f"""WITH {READINGS_SQL},
nexts AS (SELECT *, lead(glucose) OVER (PARTITION BY subject_id ORDER BY us) AS nx, {NIGHT_SQL} = 1 AS night FROM readings),
mins AS (SELECT *, {least[30]}, {least[60]} FROM nexts)
SELECT subject_id, us, {out} FROM mins"""


_EMBARGO = f"""{READINGS_SQL},
numbered AS (SELECT subject_id, us, row_number() OVER (PARTITION BY subject_id ORDER BY us) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM readings),
bounds AS (
  SELECT subject_id, max(us) FILTER (rn = CASE WHEN floor(n * 0.6::DOUBLE) > 0 THEN floor(n * 0.6::DOUBLE) ELSE n END) AS a,
    max(us) FILTER (rn = CASE WHEN floor(n * 0.8::DOUBLE) > 0 THEN floor(n * 0.8::DOUBLE) ELSE n END) AS b FROM numbered GROUP BY subject_id),
parts AS (
  SELECT subject_id, us, CASE WHEN us <= a THEN 'train' WHEN us > a + 3600000000 AND us <= b THEN 'validation' WHEN us > b + 3600000000 THEN 'test' END AS split
  FROM numbered JOIN bounds USING (subject_id)),
kept AS (SELECT * FROM parts WHERE split IS NOT NULL)"""

_R6 = lambda e, name: f"round({e}, 6) AS {name}"

def _matrix() -> str:
    r9 = lambda e, name: f"round({e}, 9) AS {name}"
    f = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    raw = [r9(v, v) for v in schema.SIGNALS]
    sugar = ["0 AS glucose_missing", r9("glucose", "glucose_current"), "0 AS glucose_interpolated", "0.0::DOUBLE AS minutes_since_last_glucose"]
    sugar += [r9(f"glucose - {lag_sql(m, 'glucose')}", f"glucose_delta_{m}m") for m in (5, 15)] + [r9(f"(glucose - {lag_sql(m, 'glucose')}) / {m}", f"glucose_roc_{m}m") for m in (5, 15, 30)]
    sugar += [r9(f"{f[k]}(glucose) OVER w{m}", f"glucose_rolling_{k}_{m}m") for m in (30, 60) for k in STATS.split()]
    bolus, carbs = ("sum(coalesce({0}, 0)) OVER w{1}".format(c, "{m}") for c in ("bolus_insulin", "carbohydrates"))
    insulin = [r9(bolus.format(m=m), f"insulin_bolus_last_{m}m") for m in (15, 30, 60)] + [r9(since_sql("bolus_insulin > 0"), "minutes_since_bolus")]
    insulin += [r9(bolus.format(m=m), n) for m, n in ((30, "bolus_insulin_recent"), (30, "total_insulin_last_30m"), (60, "total_insulin_last_60m"))] + [r9("last_value(basal_insulin IGNORE NULLS) OVER upto", n) for n in ("basal_current", "basal_insulin_current")]
    meals = [r9(carbs.format(m=m), n) for m, n in ((30, "carbs_last_30m"), (60, "carbs_last_60m"), (30, "carbs_recent"))] + [r9(since_sql("carbohydrates > 0"), n) for n in ("minutes_since_meal", "minutes_since_last_meal")]
    worn = [r9("hr", "hr_current"), r9("avg(hr) OVER w30", "hr_rolling_mean_30m"), r9("stddev_samp(hr) OVER w30", "hr_rolling_std_30m"), r9("e", "eda_current"), r9("avg(e) OVER w30", "eda_rolling_mean_30m"), r9("t", "temp_current"), r9("avg(t) OVER w30", "temp_rolling_mean_30m"), r9("a", "acc_magnitude"), r9("avg(a) OVER w15", "acc_rolling_mean_15m"), r9("stddev_samp(a) OVER w15", "acc_rolling_std_15m")]
    clock = ["CAST((us // 3600000000) % 24 AS INTEGER) AS hour_of_day", "CAST((us // 60000000) % 1440 AS INTEGER) AS minute_of_day", "CAST(isodow(make_timestamp(us)) - 1 AS INTEGER) AS day_of_week", f"{NIGHT_SQL} AS is_night_clock_based"]
    own = [r9(f"{k}(glucose) OVER w1440", n) for k, n in (("avg", "personal_glucose_baseline_24h"), ("stddev_samp", "personal_glucose_std_24h"), ("avg", "patient_glucose_baseline"))]
    own += [r9("glucose - avg(glucose) OVER w1440", "glucose_deviation_from_baseline"), r9("coalesce(stddev_samp(glucose) OVER w1440, 0)", "patient_glucose_std"), r9("avg(heart_rate) OVER w1440", "personal_hr_baseline_24h")]
    least = [f"min(nx) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {m * 60_000_000 - 1} FOLLOWING) AS m{m}" for m in (30, 60)]
    labels = [f"CAST({e} AS DOUBLE) AS {n}" for m in (30, 60) for e, n in ((f"m{m} < 70", f"future_hypoglycemia_{m}m"), (f"m{m} < 54", f"future_severe_hypoglycemia_{m}m"), (f"CASE WHEN m{m} IS NOT NULL THEN m{m} < 70 AND is_night_clock_based = 1 END", f"future_nocturnal_hypoglycemia_{m}m"))]
    carried = ", ".join(f"last_value({e} IGNORE NULLS) OVER upto AS {n}" for e, n in (("heart_rate", "hr"), ("eda", "e"), ("skin_temperature", "t"), ("sqrt(accelerometer_x * accelerometer_x + accelerometer_y * accelerometer_y + accelerometer_z * accelerometer_z)", "a")))
    positive = ", ".join(f"CASE WHEN {v} >= 0 THEN {v} END AS {v}" for v in ("basal_insulin", "bolus_insulin", "carbohydrates"))
    return f"""WITH {READINGS_SQL},
good AS (SELECT * REPLACE ({positive}) FROM readings WHERE glucose BETWEEN 20 AND 600),
held AS (SELECT *, {carried}, lead(glucose) OVER w AS nx FROM good WINDOW {WINDOWS}),
wide AS (SELECT subject_id, us, {', '.join(raw + sugar + insulin + meals + worn + clock + own + least)} FROM held WINDOW {WINDOWS}),
labelled AS (SELECT * EXCLUDE (m30, m60), {', '.join(labels)} FROM wide)
SELECT * FROM labelled QUALIFY count(*) OVER (PARTITION BY subject_id) >= 50 AND count(future_hypoglycemia_30m) OVER (PARTITION BY subject_id) >= 30 AND count(future_hypoglycemia_60m) OVER (PARTITION BY subject_id) >= 30"""


SQL = {
    "feature_matrix": _matrix(),
    "sync_readings": f"WITH {READINGS_SQL} SELECT subject_id, us, {', '.join(_R6(v, v) for v in schema.SIGNALS)} FROM readings",
    "quality_dedup": f"""WITH {RECORDS_SQL},
first_rows AS (SELECT subject_id, us, seq, glucose FROM records WHERE stream = 'cgm' QUALIFY row_number() OVER (PARTITION BY subject_id, us ORDER BY seq) = 1)
SELECT * FROM first_rows WHERE glucose BETWEEN 20 AND 600""",
    "validation_report": f"""WITH {RECORDS_SQL},
b AS (SELECT *, lag(us) OVER (PARTITION BY subject_id, stream ORDER BY seq) AS before FROM records)
SELECT subject_id, stream, seq, us, 'error' AS severity, 'Non-chronological ordering' AS message FROM b WHERE us < before
UNION ALL SELECT subject_id, stream, seq, us, 'warning', 'Duplicate timestamp' FROM b WHERE us = before
UNION ALL SELECT subject_id, stream, seq, us, 'error', 'Negative glucose value' FROM b WHERE stream = 'cgm' AND glucose < 0
UNION ALL SELECT subject_id, stream, seq, us, 'error', 'Negative basal insulin' FROM b WHERE stream = 'insulin' AND basal_insulin < 0
UNION ALL SELECT subject_id, stream, seq, us, 'error', 'Negative bolus insulin' FROM b WHERE stream = 'insulin' AND bolus_insulin < 0
UNION ALL SELECT subject_id, stream, seq, us, 'error', 'Negative carbohydrates' FROM b WHERE stream = 'meal' AND carbohydrates < 0""",
    "validity": f"""WITH {RECORDS_SQL},
b AS (SELECT *, lag(us) OVER (PARTITION BY subject_id, stream ORDER BY seq) AS before FROM records),
c AS (SELECT count(DISTINCT subject_id) AS n_subjects, count(*) FILTER (us < before) + count(*) FILTER (stream = 'cgm' AND glucose < 0) + count(*) FILTER (basal_insulin < 0) + count(*) FILTER (bolus_insulin < 0) + count(*) FILTER (carbohydrates < 0) AS e,
  count(*) FILTER (us = before) AS n_warnings FROM b)
SELECT n_subjects, e + CASE WHEN n_subjects > 1 THEN 1 ELSE 0 END AS n_errors, n_warnings, e = 0 AND n_subjects <= 1 AS valid FROM c""",
    "stream_report": f"WITH {RECORDS_SQL} SELECT stream, count(*) AS n_records, count(DISTINCT subject_id) AS n_subjects, min(us) AS first_us, max(us) AS last_us, count(DISTINCT (subject_id, us // 300000000)) AS n_slots FROM records GROUP BY stream",
    "context_features": f"""WITH {READINGS_SQL} SELECT subject_id, us, CAST((us // 3600000000) % 24 AS INTEGER) AS hour_of_day, CAST((us // 60000000) % 1440 AS INTEGER) AS minute_of_day,
CAST(isodow(make_timestamp(us)) - 1 AS INTEGER) AS day_of_week, {NIGHT_SQL} AS is_night_clock_based FROM readings""",
    "cgm_interpolate": f"WITH {CURRENT_SQL} SELECT subject_id, us, glucose_missing, round(glucose_current, 6) AS glucose_current, CAST(glucose_missing = 1 AND glucose_current IS NOT NULL AS INTEGER) AS glucose_interpolated, {_R6(since_sql('glucose_current IS NOT NULL'), 'minutes_since_last_glucose')} FROM filled WINDOW {WINDOWS}",
    "cgm_lag_roc": f"WITH {CURRENT_SQL} SELECT subject_id, us, " + ", ".join([_R6(f"glucose_current - {lag_sql(m)}", f"glucose_delta_{m}m") for m in (5, 15)] + [_R6(f"(glucose_current - {lag_sql(m)}) / {m}", f"glucose_roc_{m}m") for m in (5, 15, 30)]) + " FROM filled",
    "cgm_rolling_30m": _rolling(30),
    "cgm_rolling_60m": _rolling(60),
    "insulin_features": f"WITH {READINGS_SQL} SELECT subject_id, us, " + ", ".join(_R6(f"sum(coalesce(bolus_insulin, 0)) OVER w{m}", f"insulin_bolus_last_{m}m") for m in (15, 30, 60)) + f", {_R6(since_sql('bolus_insulin > 0'), 'minutes_since_bolus')}, round(last_value(basal_insulin IGNORE NULLS) OVER upto, 6) AS basal_current FROM readings WINDOW {WINDOWS}",
    "meal_features": f"WITH {READINGS_SQL} SELECT subject_id, us, " + ", ".join(_R6(f"sum(coalesce(carbohydrates, 0)) OVER w{m}", f"carbs_last_{m}m") for m in (30, 60)) + f", {_R6(since_sql('carbohydrates > 0'), 'minutes_since_meal')} FROM readings WINDOW {WINDOWS}",
    "wearable_features": f"""WITH {READINGS_SQL},
h AS (SELECT subject_id, us, last_value(heart_rate IGNORE NULLS) OVER upto AS hr, last_value(eda IGNORE NULLS) OVER upto AS e, last_value(skin_temperature IGNORE NULLS) OVER upto AS t,
  last_value(sqrt(accelerometer_x * accelerometer_x + accelerometer_y * accelerometer_y + accelerometer_z * accelerometer_z) IGNORE NULLS) OVER upto AS a FROM readings WINDOW {WINDOWS})
SELECT subject_id, us, {_R6('hr', 'hr_current')}, {_R6('avg(hr) OVER w30', 'hr_rolling_mean_30m')}, {_R6('stddev_samp(hr) OVER w30', 'hr_rolling_std_30m')}, {_R6('e', 'eda_current')}, {_R6('avg(e) OVER w30', 'eda_rolling_mean_30m')},
  {_R6('t', 'temp_current')}, {_R6('avg(t) OVER w30', 'temp_rolling_mean_30m')}, {_R6('a', 'acc_magnitude')}, {_R6('avg(a) OVER w15', 'acc_rolling_mean_15m')}, {_R6('stddev_samp(a) OVER w15', 'acc_rolling_std_15m')} FROM h WINDOW {WINDOWS}""",
    "baseline_24h": f"""WITH {READINGS_SQL},
b AS (SELECT subject_id, us, glucose, avg(glucose) OVER w1440 AS m, stddev_samp(glucose) OVER w1440 AS s, avg(heart_rate) OVER w1440 AS h FROM readings WINDOW {WINDOWS})
SELECT subject_id, us, round(m, 9) AS personal_glucose_baseline_24h, round(s, 9) AS personal_glucose_std_24h, round(glucose - m, 9) AS glucose_deviation_from_baseline, round(coalesce(s, 0), 9) AS patient_glucose_std, round(h, 9) AS personal_hr_baseline_24h FROM b""",
    "labels_30m": _labels({"future_hypoglycemia_30m": "m30 < 70"}),
    "labels_60m": _labels({"future_hypoglycemia_60m": "m60 < 70"}),
    "labels_severe": _labels({"future_severe_hypoglycemia_30m": "m30 < 54", "future_severe_hypoglycemia_60m": "m60 < 54"}),
    "labels_nocturnal": _labels({f"future_nocturnal_hypoglycemia_{m}m": f"CASE WHEN m{m} IS NOT NULL THEN m{m} < 70 AND night END" for m in (30, 60)}),
    "labels_strict": _labels({"future_hypoglycemia_30m": "m30 < 70", "future_hypoglycemia_60m": "m60 < 70"}, True),
    "window_trim": f"""SELECT * FROM (
  SELECT * FROM ({_labels({"glucose": "glucose", "future_hypoglycemia_30m": "m30 < 70", "future_hypoglycemia_60m": "m60 < 70"})}) QUALIFY us >= min(us) OVER (PARTITION BY subject_id) + 3600000000)
QUALIFY us <= max(us) OVER (PARTITION BY subject_id) - 3600000000 AND future_hypoglycemia_30m IS NOT NULL AND future_hypoglycemia_60m IS NOT NULL""",
    "split_two_way": f"WITH {READINGS_SQL} SELECT subject_id, us, CASE WHEN row_number() OVER (PARTITION BY subject_id ORDER BY us) <= floor(count(*) OVER (PARTITION BY subject_id) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM readings",
    "split_positional": f"WITH {READINGS_SQL}, n AS (SELECT subject_id, us, row_number() OVER (PARTITION BY subject_id ORDER BY us) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM readings) SELECT subject_id, us, CASE WHEN rn <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM n",
    "split_embargo": f"WITH {_EMBARGO} SELECT * FROM kept",
    "split_leak_audit": f"""WITH {_EMBARGO},
e AS (SELECT subject_id, {', '.join(f"{f}(us) FILTER (split = '{s}') AS {s}_{n}_us" for s in ('train', 'validation', 'test') for f, n in (('min', 'first'), ('max', 'last')))} FROM kept GROUP BY subject_id)
SELECT *, coalesce(train_last_us + 3600000000 < validation_first_us, true) AND coalesce(validation_last_us + 3600000000 < test_first_us, true) AND coalesce(train_last_us < test_first_us, true) AS leak_free FROM e""",
    "split_subject_hash": f"""WITH {RECORDS_SQL}, s AS (SELECT DISTINCT subject_id FROM records), h AS (SELECT subject_id, CAST(CAST('0x' || substr(md5('42:' || subject_id), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS share FROM s)
SELECT subject_id, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'validation' ELSE 'test' END AS split FROM h""",
    "union_splits": f"WITH {_EMBARGO} SELECT subject_id, split, count(*) AS n FROM kept GROUP BY ALL",
    "subject_semijoin": "SELECT subject_id, record_id FROM canonical_records WHERE subject_id IN (SELECT patient_id FROM cgm_records WHERE patient_id IS NOT NULL)",
    "canonical_adapter": 'SELECT subject_id, "timestamp", ' + ", ".join(f"CASE WHEN NOT isnan({v}) THEN {v} END AS {v}" for v in ("glucose", "insulin", "basal", "bolus", "carbs", "steps", "heart_rate", "eda", "skin_temperature")) + " FROM canonical_records",
    "positional_join": """
SELECT meal_id, carbohydrates, insu_id, bolus_insulin
FROM (SELECT rec_id AS meal_id, carbohydrates, row_number() OVER (ORDER BY rec_id) AS n FROM meal_records)
FULL JOIN (SELECT rec_id AS insu_id, bolus_insulin, row_number() OVER (ORDER BY rec_id) AS n FROM insulin_records) USING (n)""",
    "split_routed": f"""WITH {READINGS_SQL},
h AS (SELECT DISTINCT patient_id AS subject_id, CAST(CAST('0x' || substr(md5('42:' || patient_id), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS share FROM meal_records WHERE patient_id IS NOT NULL AND "timestamp" IS NOT NULL)
SELECT subject_id, us, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'validation' ELSE 'test' END AS split FROM readings LEFT JOIN h USING (subject_id)""",
    "lag_and_last": f"""WITH {READINGS_SQL} SELECT subject_id, us, round({lag_sql(10, 'glucose')}, 6) AS glucose_10m_ago,
  last_value(CASE WHEN glucose < 70 THEN us END IGNORE NULLS) OVER upto AS last_low_us FROM readings WINDOW {WINDOWS}""",
    "sanitised_features": f"""WITH {CURRENT_SQL},
r AS (SELECT subject_id, us, glucose_current, (glucose_current - {lag_sql(5)}) / 5 AS roc, lead(glucose) OVER (PARTITION BY subject_id ORDER BY us) AS nx FROM filled)
SELECT subject_id, us, round(glucose_current, 6) AS glucose_current, round(CASE WHEN roc <> 0 THEN 1 / roc END, 6) AS minutes_per_unit, {NIGHT_SQL} AS is_night_clock_based,
  CAST(min(nx) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) < 70 AS DOUBLE) AS future_hypoglycemia_30m FROM r""",
    "split_sizes": f"""WITH {RECORDS_SQL}, c AS (SELECT count(DISTINCT subject_id) AS n FROM records),
p AS (SELECT '60/20/20' AS kind, n, floor(n * 0.6::DOUBLE) AS a, floor(n * 0.8::DOUBLE) AS b FROM c UNION ALL SELECT '70/15/15', n, floor(n * 0.7::DOUBLE), floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) FROM c)
SELECT kind, 'train' AS split, CAST(a AS BIGINT) AS n FROM p UNION ALL SELECT kind, 'validation', CAST(b - a AS BIGINT) FROM p UNION ALL SELECT kind, 'test', CAST(n - b AS BIGINT) FROM p""",
    "sample_subjects": f"WITH {RECORDS_SQL}, c AS (SELECT least(50, count(DISTINCT subject_id)) AS n FROM records) SELECT kind, n, n AS n_different, n AS n_known FROM c, (VALUES ('hash'), ('seeded')) k(kind)",
    "bootstrap_sizes": f"WITH {READINGS_SQL} SELECT CAST(member AS INTEGER) AS member, (SELECT count(*) FROM readings) AS n_rows, true AS near, true AS with_repeats, true AS several_times FROM range(10) m(member)",
    "shuffled_train": f"""WITH {READINGS_SQL},
t AS (SELECT subject_id, us FROM readings QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY us) <= floor(count(*) OVER (PARTITION BY subject_id) * 0.8::DOUBLE))
SELECT subject_id, us, row_number() OVER (ORDER BY md5('42:' || subject_id || ':' || us), subject_id, us) - 1 AS place FROM t""",
    "top_subjects": "SELECT subject_id, count(*) AS n FROM canonical_records WHERE subject_id IS NOT NULL GROUP BY subject_id ORDER BY n DESC, subject_id LIMIT 10",
    "semantic_columns": """WITH words(grp, keyword) AS (VALUES """
    + ", ".join(f"('{g}', '{w}')" for g, ws in parquet.GROUPS.items() for w in ws)
    + """), cols AS (SELECT column_name FROM information_schema.columns WHERE table_name = 'canonical_records'),
hits AS (SELECT grp, keyword, column_name, lower(column_name) = lower(keyword) AS same FROM words JOIN cols ON contains(lower(column_name), lower(keyword)))
SELECT grp AS "group", keyword, CASE WHEN same THEN 'CONFIRMED' ELSE 'POSSIBLE' END AS status, column_name FROM hits
UNION ALL SELECT grp, keyword, 'NOT FOUND', NULL FROM words WHERE keyword NOT IN (SELECT keyword FROM hits)""",
}
