"""Adapters from stored tables to stream records and canonical records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.session import broadcast_if_small, micros, table

#: Column names of the wide parquet data set and of its canonical form.
DATASET_NAMES = {
    "id": "subject_id",
    "date": "timestamp",
    "CGM": "glucose",
    "insulin": "insulin",
    "basal": "basal",
    "bolus": "bolus",
    "carbs": "carbs",
    "steps": "steps",
    "heartrate": "heart_rate",
    "galvanic_skin_response": "eda",
    "skin_temp": "skin_temperature",
}


def number(column: str | Column) -> Column:
    """A double; NULL where empty, unparsable or NaN."""
    column = F.col(column) if isinstance(column, str) else column
    parsed = column.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def canonical(df: DataFrame, names: Mapping[str, str] = DATASET_NAMES) -> DataFrame:
    """Canonical records of a wide data set: renamed and cast, other columns dropped, absent ones NULL,
    NaN to NULL. Without an id or a time column the result is empty."""
    by_target = {target: source for source, target in names.items() if source in df.columns}
    spark = df.sparkSession
    if not {"subject_id", "timestamp"} <= by_target.keys():
        return spark.createDataFrame([], schema.CANONICAL)

    def field(f) -> Column:
        source = by_target.get(f.name)
        if source is None:
            return F.lit(None).cast(f.dataType).alias(f.name)
        quoted = F.col(f"`{source}`")
        return (number(quoted) if f.dataType.simpleString() == "double" else quoted.cast(f.dataType)).alias(f.name)

    return df.select(*(field(f) for f in schema.CANONICAL))


def stream(df: DataFrame, name: str) -> DataFrame:
    """Stream records of one record table (rec_id, patient_id, timestamp, values). Rows without subject or
    time are left out; absent value columns are NULL."""
    own = schema.VALUES[name]
    values = [(number(v) if v in own and v in df.columns else F.lit(None).cast("double")).alias(v) for v in schema.SIGNALS]
    rows = df.select(F.col("patient_id").alias("subject_id"), F.lit(name).alias("stream"), F.lit(schema.STREAMS.index(name)).alias("rank"), F.col("rec_id").alias("seq"), micros("timestamp").alias("us"), *values)
    return rows.where(F.col("subject_id").isNotNull() & F.col("us").isNotNull())


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """The four stream tables of a folder as one table of stream records."""
    rows = None
    for name in schema.STREAMS:
        part = stream(table(spark, folder, f"{name}_records"), name)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def of_subjects(df: DataFrame, ids: DataFrame, key: str = "subject_id", max_rows: int = 100_000) -> DataFrame:
    """Rows of the given subjects (semi join). The id list is broadcast only when it has at most max_rows rows."""
    wanted, _ = broadcast_if_small(ids.select(key).distinct(), max_rows)
    return df.join(wanted, key, "left_semi")
