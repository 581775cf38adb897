"""Parquet metadata and column classification."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Words that tell what a column holds, by group.
GROUPS = {
    "Identity": ("subject_id", "session_id", "record_id", "id"),
    "Time": ("timestamp", "date", "datetime", "timezone"),
    "Glucose": ("CGM", "glucose", "glucose_value", "glucose_timestamp"),
    "Insulin": ("insulin", "basal", "bolus", "insulin_dose", "insulin_timestamp"),
    "Meals": ("carbohydrate", "carbs", "meal", "nutrition", "food"),
    "Activity": ("steps", "activity", "accelerometer", "exercise"),
    "Wearables": ("heart_rate", "HR", "EDA", "skin_temperature", "temperature"),
    "Sleep": ("sleep", "sleep_stage", "sleep_duration"),
}


def sql_over(spark: SparkSession, path: str, statement: str) -> DataFrame:
    """Result of a SQL statement in which {rows} stands for the Parquet files at path; filters and columns reach the scan."""
    return spark.sql(statement, rows=spark.read.parquet(path))


def semantic_columns(df: DataFrame) -> DataFrame:
    """(group, keyword, status, column_name): CONFIRMED where a column equals a keyword whatever the case, POSSIBLE
    where it holds it, NOT FOUND (column NULL) where no column does. Reads the schema only."""
    rows = []
    for group, words in GROUPS.items():
        for word in words:
            equal = [c for c in df.columns if c.lower() == word.lower()]
            partly = [c for c in df.columns if word.lower() in c.lower() and c not in equal]
            rows += [(group, word, "CONFIRMED", c) for c in equal] + [(group, word, "POSSIBLE", c) for c in partly]
            if not equal and not partly:
                rows.append((group, word, "NOT FOUND", None))
    return df.sparkSession.createDataFrame(rows, "`group` string, keyword string, status string, column_name string")


def file_metadata(df: DataFrame) -> DataFrame:
    """(file_path, n_row_groups, n_rows, n_columns, file_size) of the Parquet files behind df, as the plan lists them: no row is read. Footers are
    read in tasks, from any file system pyarrow knows."""
    files = df.sparkSession.createDataFrame([(f,) for f in df.inputFiles()], "file_path string")

    def footers(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        for batch in batches:
            rows = []
            for uri in batch.column("file_path").to_pylist():
                system, path = FileSystem.from_uri(uri)
                m = pq.read_metadata(path, filesystem=system)
                rows.append((m.num_row_groups, m.num_rows, m.num_columns, system.get_file_info(path).size))
            columns = [batch.column("file_path"), *(pa.array(x, pa.int64()) for x in zip(*rows))] if rows else [batch.column("file_path"), *[pa.array([], pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays(columns, names=["file_path", "n_row_groups", "n_rows", "n_columns", "file_size"])

    return files.mapInArrow(footers, "file_path string, n_row_groups bigint, n_rows bigint, n_columns bigint, file_size bigint")
