"""Small frames of canonical records and readings."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

CANONICAL = "record_id bigint, subject_id string, timestamp timestamp_ntz, glucose double, bolus double, carbs double, heart_rate double, skin_temperature double"
READINGS = "subject_id string, us bigint, glucose double, basal_insulin double, bolus_insulin double, carbohydrates double, heart_rate double, eda double, skin_temperature double, accelerometer_x double, accelerometer_y double, accelerometer_z double"
START = datetime(2026, 1, 1, 8)
START_US = int(START.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def canonical(spark, rows):
    """rows: (record_id, subject, minutes or None, glucose[, bolus, carbs, heart_rate, skin_temperature])."""
    full = [(r[0], r[1], None if r[2] is None else START + timedelta(minutes=r[2]), *r[3:], *[None] * (8 - len(r))) for r in rows]
    return spark.createDataFrame(full, CANONICAL)


def readings(spark, rows):
    """rows: dicts with minutes and any value columns; subject 's' by default."""
    names = [c.split()[0] for c in READINGS.split(", ")]
    full = []
    for r in rows:
        r = {"subject_id": "s", **r, "us": START_US + int(r["minutes"] * 60_000_000)}
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, READINGS)
