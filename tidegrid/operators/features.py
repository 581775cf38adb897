"""Features of the synchronised readings, per subject and causal but for the interpolation.

Times are whole microseconds and windows are (t - d, t], as integer range frames. All windows
partition by subject and order by time, so they share one exchange; rows are five-minute slots, which
bounds a subject by its calendar. Columns that the input lacks are skipped with what depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.schema import MINUTE_US


def by_time() -> Window:
    return Window.partitionBy("subject_id").orderBy("us")


def back(minutes: int) -> Window:
    return by_time().rangeBetween(-(minutes * MINUTE_US - 1), 0)


def so_far() -> Window:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def minutes_since(when: Column) -> Column:
    """Minutes since the last row, up to this one, where the condition held."""
    return (F.col("us") - F.last(F.when(when, F.col("us")), True).over(so_far())) / F.lit(float(MINUTE_US))


def held(column: str) -> Column:
    return F.last(column, True).over(so_far())


#: Layers of columns by name: a layer may use what the layers before it add. Windows of one layer and order share one step of the plan, so groups of
#: features that are made together keep their layers side by side. Names that begin with an underscore don't last.
Layers = list[dict[str, Column]]


def layered(df: DataFrame, *groups: Layers) -> DataFrame:
    """df with the columns of all groups, layer by layer."""
    for depth in range(max(map(len, groups), default=0)):
        columns = {name: c for layers in groups if depth < len(layers) for name, c in layers[depth].items()}
        if columns:
            df = df.withColumns(columns)
    return df.drop(*(name for layers in groups for layer in layers for name in layer if name.startswith("_")))


def interpolation_layers(limit: int = 2, causal: bool = False) -> Layers:
    known = F.col("glucose").isNotNull()
    late = Window.partitionBy("subject_id").orderBy(F.desc("us")).rowsBetween(Window.unboundedPreceding, 0)
    time = F.when(known, F.col("us"))
    line = F.col("_g0") + (F.col("_g1") - F.col("_g0")) * (F.col("us") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    filled = F.col("_g0") if causal else F.when(F.col("_g1").isNotNull(), line).otherwise(F.col("_g0"))
    return [
        {} if causal else {"_g1": F.last("glucose", True).over(late), "_t1": F.last(time, True).over(late)},
        {"_g0": held("glucose"), "_t0": F.last(time, True).over(so_far()), "_n": F.row_number().over(by_time())},
        {"_k": F.col("_n") - F.last(F.when(known, F.col("_n")), True).over(so_far())},
        {"glucose_missing": (~known).cast("int"), "glucose_current": F.when(known, F.col("glucose")).when(F.col("_k") <= limit, filled)},
        {"glucose_interpolated": (~known & F.col("glucose_current").isNotNull()).cast("int")},
    ]


def interpolated(df: DataFrame, limit: int = 2, causal: bool = False) -> DataFrame:
    """glucose_missing, glucose_current and glucose_interpolated.

    The first `limit` rows of any gap are filled on the line between the readings around it, or with the
    last reading when none follows (or always, if causal); a leading gap stays NULL.
    """
    return layered(df, interpolation_layers(limit, causal))


STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def glucose_layers(columns: list[str], causal: bool = False) -> Layers:
    if "glucose" not in columns:
        return []
    g = F.col("glucose_current")
    lag = lambda m: F.first("glucose_current").over(by_time().rangeBetween(-m * MINUTE_US, -m * MINUTE_US))
    windows = {"minutes_since_last_glucose": minutes_since(g.isNotNull())} | {f"_lag{m}": lag(m) for m in (5, 15, 30)}
    windows |= {f"glucose_rolling_{name}_{m}m": f("glucose_current").over(back(m)) for m in (30, 60) for name, f in STATISTICS.items()}
    changes = {f"glucose_delta_{m}m": g - F.col(f"_lag{m}") for m in (5, 15)} | {f"glucose_roc_{m}m": (g - F.col(f"_lag{m}")) / m for m in (5, 15, 30)}
    layers = interpolation_layers(causal=causal)
    return [*layers[:-1], layers[-1] | windows, changes]


def insulin_layers(columns: list[str]) -> Layers:
    windows, aliases = {}, {}
    if "bolus_insulin" in columns:
        bolus = F.coalesce("bolus_insulin", F.lit(0.0))
        windows |= {f"insulin_bolus_last_{m}m": F.sum(bolus).over(back(m)) for m in (15, 30, 60)} | {"minutes_since_bolus": minutes_since(bolus > 0)}
        aliases |= {"bolus_insulin_recent": F.col("insulin_bolus_last_30m")} | {f"total_insulin_last_{m}m": F.col(f"insulin_bolus_last_{m}m") for m in (30, 60)}
    if "basal_insulin" in columns:
        windows["basal_current"] = held("basal_insulin")
        aliases["basal_insulin_current"] = F.col("basal_current")
    return [{}, windows, aliases]


def meal_layers(columns: list[str]) -> Layers:
    if "carbohydrates" not in columns:
        return []
    carbs = F.coalesce("carbohydrates", F.lit(0.0))
    windows = {f"carbs_last_{m}m": F.sum(carbs).over(back(m)) for m in (30, 60)} | {"minutes_since_meal": minutes_since(carbs > 0)}
    return [{}, windows, {"carbs_recent": F.col("carbs_last_30m"), "minutes_since_last_meal": F.col("minutes_since_meal")}]


def wearable_layers(columns: list[str]) -> Layers:
    current, rolling = {}, {}
    for source, name, stats in (("heart_rate", "hr", ("mean", "std")), ("eda", "eda", ("mean",)), ("skin_temperature", "temp", ("mean",))):
        if source in columns:
            current[f"{name}_current"] = held(source)
            rolling |= {f"{name}_rolling_{s}_30m": STATISTICS[s](f"{name}_current").over(back(30)) for s in stats}
    axes = [f"accelerometer_{x}" for x in "xyz"]
    if all(x in columns for x in axes):
        current["acc_magnitude"] = F.last(F.sqrt(sum((F.col(x) * F.col(x) for x in axes[1:]), F.col(axes[0]) * F.col(axes[0]))), True).over(so_far())
        rolling |= {f"acc_rolling_{s}_15m": STATISTICS[s]("acc_magnitude").over(back(15)) for s in ("mean", "std")}
    return [{}, current, rolling]


def context_layers(night_start: int = 22, night_end: int = 6) -> Layers:
    minute = F.floor(F.pmod("us", F.lit(1440 * MINUTE_US)) / F.lit(MINUTE_US)).cast("int")
    hour = F.floor(minute / 60).cast("int")
    late, early = hour >= night_start, hour < night_end
    night = (late | early) if night_start > night_end else (late & early)
    day = F.pmod(F.floor(F.col("us") / F.lit(1440 * MINUTE_US)) + 3, F.lit(7)).cast("int")
    return [{"hour_of_day": hour, "minute_of_day": minute, "day_of_week": day, "is_night_clock_based": night.cast("int")}]


def baseline_layers(columns: list[str]) -> Layers:
    day = back(24 * 60)
    windows, own = {}, {}
    if "glucose" in columns:
        windows |= {"personal_glucose_baseline_24h": F.avg("glucose").over(day), "personal_glucose_std_24h": F.stddev_samp("glucose").over(day)}
        mean, std = F.col("personal_glucose_baseline_24h"), F.col("personal_glucose_std_24h")
        own |= {"glucose_deviation_from_baseline": F.col("glucose") - mean, "patient_glucose_baseline": mean, "patient_glucose_std": F.coalesce(std, F.lit(0.0))}
    if "heart_rate" in columns:
        windows["personal_hr_baseline_24h"] = F.avg("heart_rate").over(day)
    return [{}, windows, own]


def label_layers(columns: list[str], horizons: tuple[int, ...] = (30, 60), strict: bool = False) -> Layers:
    source = "glucose" if "glucose" in columns else "glucose_current"
    frame = lambda m: by_time().rangeBetween(1, m * MINUTE_US) if strict else by_time().rangeBetween(0, m * MINUTE_US - 1)
    low, night = {}, {}
    for m in horizons:
        least = F.col(f"_least{m}")
        low |= {f"future_hypoglycemia_{m}m": (least < schema.LOW).cast("double"), f"future_severe_hypoglycemia_{m}m": (least < schema.VERY_LOW).cast("double")}
        if "is_night_clock_based" in columns:
            is_low = F.col(f"future_hypoglycemia_{m}m")
            night[f"future_nocturnal_hypoglycemia_{m}m"] = F.when(is_low.isNotNull(), F.when((is_low == 1) & (F.col("is_night_clock_based") == 1), 1.0).otherwise(0.0))
    return [{}, {"_next": F.lead(source, 1).over(by_time())}, {f"_least{m}": F.min(source if strict else "_next").over(frame(m)) for m in horizons}, low, night]


def glucose_features(df: DataFrame, causal: bool = False) -> DataFrame:
    return layered(df, glucose_layers(df.columns, causal))


def insulin_features(df: DataFrame) -> DataFrame:
    return layered(df, insulin_layers(df.columns))


def meal_features(df: DataFrame) -> DataFrame:
    return layered(df, meal_layers(df.columns))


def wearable_features(df: DataFrame) -> DataFrame:
    return layered(df, wearable_layers(df.columns))


def context_features(df: DataFrame, night_start: int = 22, night_end: int = 6) -> DataFrame:
    """hour_of_day, minute_of_day, day_of_week (Monday 0) and is_night_clock_based, in UTC."""
    return layered(df, context_layers(night_start, night_end))


def baseline_features(df: DataFrame) -> DataFrame:
    """Mean and deviation of the subject's own last 24 hours, of glucose as read and of heart rate."""
    return layered(df, baseline_layers(df.columns))


def with_labels(df: DataFrame, horizons: tuple[int, ...] = (30, 60), strict: bool = False) -> DataFrame:
    """Labels of the coming minutes, 1, 0 or NULL: low, very low and low at night (by the clock of the row).

    The value of a row is that of the row after it, however far; its least over [t, t + d) decides. If strict, the
    least reading within (t, t + d] does.
    """
    return layered(df, label_layers(df.columns, horizons, strict))


def all_features(readings: DataFrame, causal: bool = False) -> DataFrame:
    """Every feature and label of the readings, behind one exchange by subject and in a handful of window steps."""
    have = [*readings.columns, "is_night_clock_based"]
    groups = glucose_layers(have, causal), insulin_layers(have), meal_layers(have), wearable_layers(have), context_layers(), baseline_layers(have), label_layers(have)
    return layered(readings, *groups)


def hybrid_features(readings: DataFrame) -> DataFrame:
    """The groups of features and labels that the hybrid configuration takes from the readings."""
    have = [*readings.columns, "is_night_clock_based"]
    return layered(readings, glucose_layers(have), context_layers(), baseline_layers(have), label_layers(have))


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("future_")]


def trimmed(df: DataFrame, labels: list[str], lookback: int = 60, horizon: int = 60) -> DataFrame:
    """Rows at least lookback minutes after the subject's first and, of those, at least horizon minutes before the
    last; rows with an unknown label are dropped."""
    whole = Window.partitionBy("subject_id")
    df = df.withColumn("_first", F.min("us").over(whole)).where(F.col("us") >= F.col("_first") + lookback * MINUTE_US)
    df = df.withColumn("_last", F.max("us").over(whole)).where(F.col("us") <= F.col("_last") - horizon * MINUTE_US)
    return df.drop("_first", "_last").dropna(subset=labels)


def sanitised(df: DataFrame, target: str) -> tuple[list[str], DataFrame]:
    """Feature names (no label, no id) and the frame with infinite values as NULL; target is kept."""
    names = [c for c, t in df.dtypes if not c.startswith(("future_", "patient_id")) and c not in ("subject_id", "us") and t in ("double", "float", "int", "bigint")]
    finite = [F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in names]
    keys = [c for c in ("subject_id", "us") if c in df.columns]
    return names, df.select(*keys, *finite, target)


def large_enough(df: DataFrame, labels: list[str], rows: int = 50, labelled: int = 30) -> DataFrame:
    """Rows of subjects with at least `rows` rows and `labelled` known values of every label."""
    whole = Window.partitionBy("subject_id")
    ok = F.count("*").over(whole) >= rows
    for label in labels:
        ok = ok & (F.count(label).over(whole) >= labelled)
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")
