"""Session helpers: table access, checkpointing in the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder. Times are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str | Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone (session zone: UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def value_or_null(column: str | Column) -> Column:
    """NaN means "no value" just as NULL does."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(column), column)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names in spark.checkpoint.dir. Only a local
    master gets a folder of its own where that is unset (tests); elsewhere that is a RuntimeError."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def set_checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidegrid-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of the checkpoints, for what a query writes and reads back."""
    return f"{set_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Mark df for broadcast only after counting that it has at most max_rows rows.
    The count stops early; beyond the bound the frame is returned unhinted."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if small else (df, False)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row (a total, say), joined on a constant."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")
