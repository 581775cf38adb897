"""Record schemas and constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

STREAMS = ("cgm", "insulin", "meal", "wearable")
VALUES = {
    "cgm": ("glucose",),
    "insulin": ("basal_insulin", "bolus_insulin"),
    "meal": ("carbohydrates",),
    "wearable": ("heart_rate", "eda", "skin_temperature", "accelerometer_x", "accelerometer_y", "accelerometer_z"),
}
SIGNALS = tuple(v for s in STREAMS for v in VALUES[s])

#: Thresholds of low and very low glucose, plausible range, grid step, embargo.
LOW, VERY_LOW = 70.0, 54.0
PLAUSIBLE = (20.0, 600.0)
MINUTE_US = 60_000_000
SLOT_US = 5 * MINUTE_US
EMBARGO_MINUTES = 60

#: One row per record of a stream, in the order of the stream.
STREAM_RECORD = T.StructType(
    [T.StructField("subject_id", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("us", T.LongType())]
    + [T.StructField(v, T.DoubleType()) for v in SIGNALS]
)
#: One row per subject and five-minute slot.
READINGS = T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("us", T.LongType())] + [T.StructField(v, T.DoubleType()) for v in SIGNALS])
#: Subject, time and values of the wide parquet data set after the rename.
CANONICAL = T.StructType(
    [T.StructField("subject_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(v, T.DoubleType()) for v in ("glucose", "insulin", "basal", "bolus", "carbs", "steps", "heart_rate", "eda", "skin_temperature")]
)
