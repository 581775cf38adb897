"""Queries on sources and sinks: what is written to the shared folder and read back must be what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.operators import profile, sync
from tidegrid.plans.common import READINGS_SQL, readings, rounded
from tidegrid.plans.records import SQL as RECORDS
from tidegrid.plans.records import labelled
from tidegrid.session import scratch, table
from tidegrid.sources import adapters, generated, parquet, sinks, xml


def xml_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The stream tables as XML documents, one a subject and day, written, read back as a folder and put on slots."""
    path = scratch(spark, "xml")
    xml.rendered(adapters.stream_records(spark, folder)).select("xml").write.text(path)
    return rounded(sync.synchronise(xml.load_all(spark, path)).select("subject_id", "us", *schema.SIGNALS))


#: Ids, times and values of our own, with what a file may hold: an event without a time, values that are none, both forms of time.
XML_SAMPLE = """<patient id="A7"><glucose_level><event ts="14-02-2025 21:35:10" value="96.5"/><event ts="14-02-2025 21:40:12" value="101"/><event value="300"/></glucose_level>
<basal><event ts="14-02-2025 21:36:00" value="0.85"/></basal><bolus><event ts="2025-02-14T21:41:30" dose="3.25"/></bolus>
<meal><event ts="14-02-2025 21:43:00" carbs="48"/></meal><wearable><event ts="14-02-2025 21:35:40" hr="64" eda="nan" temp=""/></wearable></patient>"""


def xml_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with a sample file and a malformed one: discovered, each loaded by name, and put on slots."""
    table(spark, folder, "region")  # pins the session's time zone
    path = scratch(spark, "sample")
    for name, text in (("A7", XML_SAMPLE), ("B2", "<patient")):
        spark.createDataFrame([(text,)], "xml string").coalesce(1).write.text(f"{path}/{name}.xml")
    rows = None
    for name in xml.discover(spark, path):
        part = xml.load(spark, path, name)
        rows = part if rows is None else rows.unionByName(part)
    return sync.synchronise(rows).select("subject_id", "us", "glucose", "basal_insulin", "bolus_insulin", "carbohydrates", "heart_rate", "eda")


def parquet_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return parquet.file_metadata(table(spark, folder, "canonical_records")).drop("file_path")


def parquet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and columns of every table with records, from the files' footers."""
    rows = None
    for name in ("canonical_records", "cgm_records", "insulin_records", "meal_records", "wearable_records"):
        part = parquet.file_metadata(table(spark, folder, name)).agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns")).select(F.lit(name).alias("table_name"), "*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


_OVER = "SELECT subject_id, count(*) AS n, round(avg(glucose), 6) AS mean_glucose FROM {rows} WHERE glucose BETWEEN 70 AND 180 AND subject_id IS NOT NULL GROUP BY subject_id"


def sql_over_parquet(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "region")
    return parquet.sql_over(spark, f"{folder}/canonical_records.parquet", _OVER)


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Slots written as CSV by subject and read back."""
    path = scratch(spark, "csv")
    sinks.write_subject_csv(readings(spark, folder).select("subject_id", "us", "glucose", "carbohydrates"), path)
    return spark.read.csv(path, header=True, schema="us bigint, glucose double, carbohydrates double, subject_id string")


def chunk_reload(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both horizons with aligned columns, written by split and horizon; the train rows of the half hour read back as floats."""
    rows = labelled(readings(spark, folder)).withColumn("split", F.when(F.col("is_night_clock_based") == 1, "test").otherwise("train"))
    parts = [rows.select("subject_id", "us", "glucose", "split", f"future_hypoglycemia_{m}m", F.lit(f"{m}m").alias("horizon")) for m in (30, 60)]
    path = scratch(spark, "chunks")
    sinks.write_chunks(sinks.align(parts), path)
    back = sinks.read_chunks(spark, path, "train", "30m")
    return back.select("subject_id", "us", F.round(F.col("glucose").cast("double"), 3).alias("glucose"), *(F.col(f"future_hypoglycemia_{m}m").cast("double").alias(f"future_hypoglycemia_{m}m") for m in (30, 60)))


def guarded_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the cohort as guarded JSON."""
    row = profile.coverage(profile.cohort(table(spark, folder, "canonical_records"))).first().asDict()
    return spark.createDataFrame([(sinks.guarded_json({"cohort": row}),)], "summary string")


def generated_series(spark: SparkSession, folder: str) -> DataFrame:
    return generated.smoke_readings(spark, 100)


def generated_ablation(spark: SparkSession, folder: str) -> DataFrame:
    return generated.ablation_frame(spark)


def generated_demo(spark: SparkSession, folder: str) -> DataFrame:
    return generated.demo_readings(spark)


QUERIES = {
    "xml_folder": xml_folder,
    "xml_ingest": xml_ingest,
    "parquet_metadata": parquet_metadata,
    "parquet_rows": parquet_rows,
    "sql_over_parquet": sql_over_parquet,
    "csv_round_trip": csv_round_trip,
    "chunk_reload": chunk_reload,
    "guarded_summary": guarded_summary,
    "generated_series": generated_series,
    "generated_ablation": generated_ablation,
    "generated_demo": generated_demo,
}

_TABLES = ("canonical_records", "cgm_records", "insulin_records", "meal_records", "wearable_records")
_DAYS = "((epoch_us(max(\"timestamp\")) // 3600000000) - (epoch_us(min(\"timestamp\")) // 3600000000))"

SQL = {
    "xml_folder": RECORDS["sync_readings"],
    "xml_ingest": """SELECT * FROM (VALUES ('A7', epoch_us(TIMESTAMP '2025-02-14 21:35:00'), 96.5::DOUBLE, 0.85::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 64.0::DOUBLE, NULL::DOUBLE),
  ('A7', epoch_us(TIMESTAMP '2025-02-14 21:40:00'), 101.0, NULL, 3.25, 48.0, NULL, NULL))
t(subject_id, us, glucose, basal_insulin, bolus_insulin, carbohydrates, heart_rate, eda)""",
    "parquet_rows": " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns" for t in _TABLES),
    "sql_over_parquet": _OVER.format(rows="canonical_records"),
    "csv_round_trip": f"WITH {READINGS_SQL} SELECT subject_id, us, glucose, carbohydrates FROM readings",
    "chunk_reload": f"""WITH {READINGS_SQL},
nexts AS (SELECT *, lead(glucose) OVER (PARTITION BY subject_id ORDER BY us) AS nx, (us // 3600000000) % 24 AS hour FROM readings)
SELECT subject_id, us, round(CAST(CAST(glucose AS FLOAT) AS DOUBLE), 3) AS glucose,
  CAST(min(nx) OVER (PARTITION BY subject_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 1799999999 FOLLOWING) < 70 AS DOUBLE) AS future_hypoglycemia_30m, CAST(NULL AS DOUBLE) AS future_hypoglycemia_60m
FROM nexts QUALIFY hour >= 6 AND hour < 22""",
    "guarded_summary": f"""SELECT '{{"cohort": {{' || string_agg('"' || k || '": ' || v, ', ' ORDER BY k) || '}}}}' AS summary FROM (
  UNPIVOT (SELECT count(*) AS n_subjects, {', '.join(f'count(*) FILTER (h >= {24 * d}) AS n_{d}d' for d in (1, 7, 14, 30))}
    FROM (SELECT {_DAYS} AS h FROM canonical_records WHERE subject_id IS NOT NULL GROUP BY subject_id)) ON COLUMNS(*) INTO NAME k VALUE v)""",
    "generated_series": """SELECT 'smoke' AS subject_id, 1767268800000000 + i * 300000000 AS us, 110.0 + i % 10 AS glucose, 0.5::DOUBLE AS basal_insulin,
  CASE WHEN i = 10 THEN 5.0::DOUBLE END AS bolus_insulin, CASE WHEN i = 20 THEN 50.0::DOUBLE END AS carbohydrates FROM range(100) r(i)""",
}
