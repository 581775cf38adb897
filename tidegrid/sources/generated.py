"""Generated frames: modelling frames, a demonstration of a few hours, and a short series for smoke tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.operators.twin import Parameters

#: Fixed values of the demonstration: seed, start (2026-01-15 20:00), level, meal (step, grams), bolus (step, units), basal rate, noise, least
#: level, and bounds of a reading.
DEMO_SEED, DEMO_START_US, DEMO_LEVEL = 2026, 1_768_507_200_000_000, 135.0
DEMO_MEAL, DEMO_BOLUS, DEMO_BASAL = (6, 40.0), (8, 4.0), 0.8
DEMO_NOISE, DEMO_LEAST, DEMO_BOUNDS = 2.0, 45.0, (40.0, 400.0)

#: Fixed values of the ablation frame: ranges of even draws, in the order they are drawn.
ABLATION_BASELINE = {
    "glucose_current": (60, 200), "glucose_roc_5m": (-3, 3), "glucose_roc_15m": (-2, 2), "glucose_roc_30m": (-1, 1), "glucose_mean_30m": (80, 180), "glucose_std_30m": (5, 30),
    "glucose_min_30m": (60, 120), "glucose_max_30m": (120, 200), "insulin_recent_sum": (0, 10), "carbs_recent_sum": (0, 80), "time_since_meal": (0, 300), "time_since_bolus": (0, 300), "patient_glucose_baseline": (90, 140),
}
ABLATION_STATE = {"twin_insulin_action": (0, 2), "twin_insulin_state": (0, 3), "twin_meal_state": (0, 20), "twin_context_state": (0, 1)}
ABLATION_AHEAD = {"twin_glucose_t5": 5, "twin_glucose_t15": 10, "twin_glucose_t30": 15, "twin_glucose_t60": 20}


def modelling_frame(spark: SparkSession, rows: int, seed: int = 42, start_us: int = 1_767_225_600_000_000) -> DataFrame:
    """Generated five-minute series (subject_id, us, five features and two labels): five waves of glucose over the whole length, with noise;
    boluses and meals of exponential size; labels from the least glucose of the six rows that end 30, of the twelve that end 60 minutes later."""
    position = F.col("id") / F.lit(float(max(rows - 1, 1)))
    spread = lambda scale, k: -F.log(1 - F.rand(seed + k)) * scale
    hour = F.floor((F.col("us") % 86_400_000_000) / 3_600_000_000)
    base = spark.range(rows).select(
        F.lit("synthetic").alias("subject_id"),
        (F.lit(start_us) + F.col("id") * schema.SLOT_US).alias("us"),
        (120 + 50 * F.sin(position * F.lit(10 * math.pi)) + 5 * F.randn(seed)).alias("glucose_current"),
        spread(1.0, 1).alias("insulin_bolus_last_30m"),
        spread(5.0, 2).alias("carbs_last_30m"),
    )
    w = Window.partitionBy("subject_id").orderBy("us")
    g = F.col("glucose_current")
    before, after = F.coalesce(F.lag(g).over(w), g), F.coalesce(F.lead(g).over(w), g)
    steps = F.when(F.lag(g).over(w).isNull() | F.lead(g).over(w).isNull(), 1.0).otherwise(2.0)
    low = lambda k: (F.min(g).over(w.rowsBetween(1, k)) < schema.LOW).cast("double")
    return base.select("*", ((after - before) / steps / 5).alias("glucose_roc_5m"), ((hour >= 22) | (hour < 6)).cast("int").alias("is_night_clock_based"), low(6).alias("future_hypoglycemia_30m"), low(12).alias("future_hypoglycemia_60m"))


def demo_readings(spark: SparkSession, hours: float = 6.0, seed: int = DEMO_SEED, start_us: int = DEMO_START_US) -> DataFrame:
    """One subject's readings of some hours in five-minute slots: a meal after 30 minutes, a bolus after 40, steady basal insulin, and
    noise. Unlike the simulator's, a step lets insulin act at once. The same seed gives the same readings."""
    p = Parameters()
    steps = int(hours * 12)
    noise = np.random.default_rng(seed).normal(0, DEMO_NOISE, steps)
    eaten, given = ([amount if i == at else 0.0 for i in range(steps)] for at, amount in (DEMO_MEAL, DEMO_BOLUS))
    level, meal, insulin, action, rows = DEMO_LEVEL, 0.0, 0.0, 0.0, []
    for i, (carbs, bolus) in enumerate(zip(eaten, given)):
        absorbed = p.absorption * meal
        meal += carbs - absorbed
        insulin += bolus + DEMO_BASAL / 12 - p.clearance * insulin
        action += p.clearance * (insulin - action)
        level = max(DEMO_LEAST, level + p.drift * (DEMO_LEVEL - level) + p.conversion * absorbed - p.sensitivity * action)
        seen = round(float(np.clip(level + noise[i], *DEMO_BOUNDS)), 1)
        rows.append(("demo", start_us + i * schema.SLOT_US, seen, DEMO_BASAL, bolus, carbs, *[None] * 6))
    return spark.createDataFrame(rows, schema.READINGS)


def ablation_frame(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """Hybrid frame of even draws: 15 plain and 18 simulated features whose level follows glucose, and labels from both."""
    draw = np.random.default_rng(seed)
    c = {name: draw.uniform(low, high, rows) for name, (low, high) in ABLATION_BASELINE.items()}
    c |= {"hour_of_day": draw.integers(0, 24, rows).astype(float), "steps_available": draw.choice([0.0, 1.0], rows)}
    glucose = c["glucose_current"]
    c["twin_glucose_current"] = glucose + draw.normal(0, 3, rows)
    c |= {name: draw.uniform(low, high, rows) for name, (low, high) in ABLATION_STATE.items()}
    c |= {name: glucose + draw.uniform(-reach, reach, rows) for name, reach in ABLATION_AHEAD.items()}
    flat = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(zip(*c.values()))], "row bigint, " + ", ".join(f"{name} double" for name in c))
    now, at = F.col("twin_glucose_current"), lambda m: F.col(f"twin_glucose_t{m}")
    risk = lambda m, level: ((F.col("glucose_current") < level) | (at(m) < level)).cast("int").alias(f"future_hypoglycemia_{m}m")
    return flat.select(
        "*", *(((at(m) - now) / m).alias(f"twin_slope_{m}m") for m in (30, 60)), *((at(m) - now).alias(f"twin_delta_{m}m") for m in (15, 30, 60)), (F.col("glucose_current") - now).alias("twin_residual_current"),
        *(F.lit(0.0).alias(f"twin_{name}") for name in ("has_long_gap", "has_missing_glucose", "uncertainty_calibrated")), risk(30, 80), risk(60, 90),
    )


def smoke_readings(spark: SparkSession, rows: int = 100, start_us: int = 1_767_268_800_000_000) -> DataFrame:
    """A short five-minute series of arithmetic: glucose 110 to 119 over and over, a bolus at row 10, a meal at row 20."""
    i = F.col("id")
    return spark.range(rows).select(
        F.lit("smoke").alias("subject_id"), (F.lit(start_us) + i * schema.SLOT_US).alias("us"), (110.0 + i % 10).alias("glucose"), F.lit(0.5).alias("basal_insulin"),
        F.when(i == 10, 5.0).alias("bolus_insulin"), F.when(i == 20, 50.0).alias("carbohydrates"),
    )
