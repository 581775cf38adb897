"""Stream records onto five-minute slots, quality rules and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.chunks import chunked
from tidegrid.session import with_row


def floored(us: str = "us", slot_us: int = schema.SLOT_US) -> Column:
    return F.floor(F.col(us) / F.lit(slot_us)).cast("bigint") * F.lit(slot_us)


def synchronise(records: DataFrame, slot_us: int = schema.SLOT_US, total_amounts: bool = False) -> DataFrame:
    """One row per subject and slot with at least one record.

    In the order (time, stream, seq) the first value counts of glucose, basal, bolus and carbohydrates (their sum
    for bolus and carbohydrates if total_amounts). Wearable values come from one record: the first with a
    heart rate, or else the last. Partial aggregates are built before the shuffle, so a busy subject costs
    no more than its slots.
    """
    order = F.struct("us", "rank", "seq")
    wear = F.struct(*schema.VALUES["wearable"])
    first = lambda v: F.min_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v)
    amount = lambda v: F.sum(v).alias(v) if total_amounts else first(v)
    is_wear = F.col("stream") == "wearable"
    slots = records.withColumn("slot", floored("us", slot_us)).groupBy("subject_id", "slot").agg(
        first("glucose"), first("basal_insulin"), amount("bolus_insulin"), amount("carbohydrates"),
        F.coalesce(F.min_by(wear, F.when(is_wear & F.col("heart_rate").isNotNull(), order)), F.max_by(wear, F.when(is_wear, order))).alias("w"),
    )
    return slots.select("subject_id", F.col("slot").alias("us"), "glucose", "basal_insulin", "bolus_insulin", "carbohydrates", *(F.col(f"w.{v}").alias(v) for v in schema.VALUES["wearable"]))


def without_negatives(df: DataFrame) -> DataFrame:
    """Negative glucose and amounts to NULL; the row stays."""
    for v in ("glucose", "carbohydrates", "basal_insulin", "bolus_insulin"):
        if v in df.columns:
            df = df.withColumn(v, F.when(F.col(v) >= 0, F.col(v)))
    return df


def plausible(df: DataFrame, low: float = schema.PLAUSIBLE[0], high: float = schema.PLAUSIBLE[1]) -> DataFrame:
    """Rows with glucose within [low, high]."""
    return df.where(F.col("glucose").between(low, high))


def first_of_each_time(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Of rows with the same subject and time, the one with the lowest seq. Shuffled by both, so no subject is hot."""
    keep = [c for c in df.columns if c not in ("subject_id", "us")]
    best = df.groupBy("subject_id", "us").agg(F.min_by(F.struct(*keep), F.col(seq)).alias("r"))
    return best.select("subject_id", "us", *(F.col(f"r.{c}").alias(c) for c in keep))


def validation(records: DataFrame, target_rows: int = 1_000_000) -> DataFrame:
    """Findings per record: (subject_id, stream, seq, us, severity, message). Within a stream, in the order given by seq, an
    earlier time than before is an error and an equal one a warning; negative values are errors. Streams of more than
    target_rows records are split into overlapping chunks."""
    keyed = records.select("subject_id", "stream", "seq", "us", "glucose", "basal_insulin", "bolus_insulin", "carbohydrates", F.concat_ws("\u0000", "subject_id", "stream").alias("key"))
    w = Window.partitionBy("key", "chunk").orderBy("seq")
    before = chunked(keyed, "key", "seq", target_rows).withColumn("before", F.lag("us").over(w)).where("core")
    finding = lambda when, severity, text: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message")))
    found = [finding(F.col("us") < F.col("before"), "error", "Non-chronological ordering"), finding(F.col("us") == F.col("before"), "warning", "Duplicate timestamp")]
    for v, stream, text in (("glucose", "cgm", "glucose value"), ("basal_insulin", "insulin", "basal insulin"), ("bolus_insulin", "insulin", "bolus insulin"), ("carbohydrates", "meal", "carbohydrates")):
        found.append(finding((F.col("stream") == stream) & (F.col(v) < 0), "error", f"Negative {text}"))
    rows = before.select("subject_id", "stream", "seq", "us", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select("subject_id", "stream", "seq", "us", "f.severity", "f.message")


def validity(records: DataFrame) -> DataFrame:
    """(n_subjects, n_errors, n_warnings, valid) of one record set; more than one subject is an error."""
    found = validation(records).agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    subjects = records.agg(F.countDistinct("subject_id").alias("n_subjects"))
    errors = F.col("e") + F.when(F.col("n_subjects") > 1, 1).otherwise(0)
    return with_row(subjects, found).select("n_subjects", errors.alias("n_errors"), "n_warnings", (errors == 0).alias("valid"))


def stream_report(records: DataFrame) -> DataFrame:
    """Records, subjects, first and last time and slots per stream."""
    return records.groupBy("stream").agg(F.count("*").alias("n_records"), F.countDistinct("subject_id").alias("n_subjects"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct("subject_id", floored()).alias("n_slots"))
