"""Sinks: per-subject files, partitioned chunks with aligned columns, and guarded summaries."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_subject_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files per subject; a subject's rows go to tasks by spans of 30 days (us, if there is such a column)."""
    span = [F.floor(F.col("us") / F.lit(30 * 86_400_000_000))] if "us" in df.columns else []
    df.repartition("subject_id", *span).write.mode("overwrite").partitionBy("subject_id").csv(path, header=True)


def align(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames with the columns of any; what a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_chunks(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "horizon")) -> None:
    """Parquet partitioned by split and horizon, so that a reader prunes folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_chunks(spark: SparkSession, path: str, split: str, horizon: str, single: bool = True) -> DataFrame:
    """One split and horizon of the chunks; doubles as floats if single."""
    df = spark.read.parquet(path).where((F.col("split") == split) & (F.col("horizon") == horizon))
    return df.select(*(F.col(c).cast("float").alias(c) if single and t == "double" else F.col(c) for c, t in df.dtypes))


def guarded_json(summary: dict, most: int = 100, allowed: tuple[str, ...] = ("calibration", "fraction", "predicted", "importance")) -> str:
    """Summary as JSON; ValueError if it holds a list of more than `most` entries (a raw sequence) off the allowed paths."""

    def visit(value, path: str) -> None:
        if isinstance(value, list) and len(value) > most and not any(word in path for word in allowed):
            raise ValueError(f"a list of {len(value)} entries at {path or '/'}")
        if isinstance(value, dict):
            for key, inner in value.items():
                visit(inner, f"{path}/{key}")

    visit(summary, "")
    return json.dumps(summary, sort_keys=True)
