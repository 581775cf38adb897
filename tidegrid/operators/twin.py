"""A state-space simulator per subject: causal scan, forecasts and what-if paths.

The state (glucose, insulin action, insulin, meal) only recurs within a subject, so the scan runs over
partitions sorted by subject and time and advances many subjects in lock-step; it emits the state after
every row. Forecasts and what-if paths are folds of a row's state and stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.batching import column, whole_groups
from tidegrid.schema import MINUTE_US

STEP_MINUTES = 5
BURN_IN = 10
REFRESH = 100
#: Rows read before a batch of whole subjects is advanced, subjects that advance together, and how few go on one by one.
SCAN_ROWS, SUBJECTS, NARROW = 131_072, 1024, 8


@dataclass(frozen=True)
class Parameters:
    """The population's parameters."""

    baseline: float = 110.0
    drift: float = 0.05
    sensitivity: float = 1.0
    clearance: float = 0.1
    absorption: float = 0.05
    conversion: float = 2.0


STATE = "subject_id string, us bigint, glucose double, insulin_action double, insulin_state double, meal_state double, baseline double, observed double, missing_glucose int, long_gap int"

#: Names of the quality flags, the gap in minutes beyond which the second is set, and the status of a calibrated state.
MISSING, LONG_GAP, LONG_GAP_MINUTES, CALIBRATED = "MISSING_GLUCOSE", "LONG_GAP", 15.0, "calibrated"


@dataclass(frozen=True)
class State:
    """A subject's state at one time. Context and status only carry over from the start."""

    us: int
    glucose: float
    insulin_action: float = 0.0
    insulin_state: float = 0.0
    meal_state: float = 0.0
    context_state: float = 0.0
    flags: tuple[str, ...] = ()
    status: str = "not_calibrated"


def update(state: State, us: int, glucose: float | None = None, carbs: float | None = None, bolus: float | None = None, basal: float | None = None, baseline: float | None = None, p: Parameters = Parameters()) -> State:
    """State after one reading; NULL and NaN glucose is missing. The same time changes nothing; an earlier one is a ValueError."""
    if us < state.us:
        raise ValueError("a reading must not lie before the state")
    if us == state.us:
        return state
    minutes = (us - state.us) / MINUTE_US
    glucose = None if glucose is None or math.isnan(glucose) else glucose
    now = step((state.glucose, state.insulin_action, state.insulin_state, state.meal_state), glucose, carbs or 0.0, bolus or 0.0, basal or 0.0, minutes, p.baseline if baseline is None else baseline, p)
    flags = tuple(name for name, on in ((MISSING, glucose is None), (LONG_GAP, minutes > LONG_GAP_MINUTES)) if on)
    return replace(state, us=us, glucose=now[0], insulin_action=now[1], insulin_state=now[2], meal_state=now[3], flags=flags)


def step(state: tuple, glucose: float | None, carbs: float, bolus: float, basal: float, minutes: float, baseline: float, p: Parameters) -> tuple:
    """Next (glucose, action, insulin, meal). Rates hold per step whatever its length; only basal scales with time."""
    g, action, insulin, meal = state
    absorbed = p.absorption * meal
    after_meal = max(0.0, meal - absorbed + carbs)
    after_insulin = max(0.0, insulin - p.clearance * insulin + (bolus + basal * (minutes / 60.0)))
    after_action = max(0.0, action - p.clearance * action + p.clearance * insulin)
    if glucose is None:
        glucose = max(10.0, g + p.drift * (baseline - g) + p.conversion * absorbed - p.sensitivity * action)
    return glucose, after_action, after_insulin, after_meal


def advanced(length: np.ndarray, us, glucose, carbs, bolus, basal, baseline, p: Parameters) -> list[np.ndarray]:
    """States (glucose, action, insulin, meal) after every row of many subjects, the longest first, of which row k of each advances
    at the same time; arrays are (subjects, rows) and a missing glucose is NaN. The last few long subjects go on one by one."""
    out = [np.zeros(glucose.shape) for _ in range(4)]
    out[0][:, 0] = glucose[:, 0]
    minutes = np.diff(us, axis=1) / MINUTE_US
    active = np.searchsorted(-length, -np.arange(glucose.shape[1]), side="left")  # subjects longer than k
    k = 1
    while k < glucose.shape[1] and active[k] >= NARROW:
        m = active[k]
        g, x, i, meal = (v[:m, k - 1] for v in out)
        absorbed = p.absorption * meal
        seen, base = glucose[:m, k], baseline[:m, k]
        ahead = np.maximum(10.0, g + p.drift * (base - g) + p.conversion * absorbed - p.sensitivity * x)
        out[0][:m, k] = np.where(np.isnan(seen), ahead, seen)
        out[1][:m, k] = np.maximum(0.0, x - p.clearance * x + p.clearance * i)
        out[2][:m, k] = np.maximum(0.0, i - p.clearance * i + (bolus[:m, k] + basal[:m, k] * (minutes[:m, k - 1] / 60.0)))
        out[3][:m, k] = np.maximum(0.0, meal - absorbed + carbs[:m, k])
        k += 1
    for r in range(active[k] if k < glucose.shape[1] else 0):
        end = int(length[r])
        state = tuple(float(v[r, k - 1]) for v in out)
        rest = zip(*(v[r, k:end].tolist() for v in (glucose, carbs, bolus, basal)), minutes[r, k - 1 : end - 1].tolist(), baseline[r, k:end].tolist())
        states = [state := step(state, None if seen != seen else seen, c, b, ba, dt, base, p) for seen, c, b, ba, dt, base in rest]
        if states:
            for v, column in zip(out, zip(*states)):
                v[r, k:end] = column
    return out


def scan(batches: Iterator[pa.RecordBatch], p: Parameters, refresh: int | None = REFRESH) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (subject_id, us, burn_end, burn_mean, glucose, basal_insulin, bolus_insulin, carbohydrates) sorted by
    subject and time. A subject is held whole: its rows are slots, bounded by its calendar."""
    names = [f.split()[0] for f in STATE.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.float64()] * 6, pa.int32(), pa.int32()]
    for table, run in whole_groups(batches, ["subject_id"], SCAN_ROWS):
        us, end = column(table, "us", "int64"), column(table, "burn_end", "int64")
        glucose, mean = column(table, "glucose"), column(table, "burn_mean")
        given = [np.nan_to_num(column(table, c)) for c in ("carbohydrates", "bolus_insulin", "basal_insulin")]
        kept = np.flatnonzero((us > end) | ~np.isnan(glucose))  # only rows with glucose burn in
        _, group = np.unique(run[kept], return_inverse=True)
        length = np.bincount(group)
        order = np.argsort(-length, kind="stable")
        start = np.cumsum(length) - length
        for part in np.array_split(order, max(1, -(-len(order) // SUBJECTS))):
            n = length[part]
            if not len(n):
                continue
            at = kept[np.minimum(start[part][:, None] + np.arange(n[0]), (start[part] + n - 1)[:, None])]
            t, g, first = us[at], glucose[at], mean[at[:, 0]]
            known = ~np.isnan(g)
            count = np.cumsum(known, axis=1)
            base = np.broadcast_to(first[:, None], g.shape)
            if refresh:
                new = (t > end[at]) & (count % refresh == 0)
                held = np.maximum.accumulate(np.where(new, np.arange(g.shape[1]), -1), axis=1)
                means = np.cumsum(np.where(known, g, 0.0), axis=1) / np.maximum(count, 1)
                base = np.where(held >= 0, np.take_along_axis(means, np.maximum(held, 0), 1), base)
            states = advanced(n, t, g, *(v[at] for v in given), base, p)
            emitted = (np.arange(g.shape[1]) < n[:, None]) & ((t > end[at]) | ((t == end[at]) if refresh is None else False))
            gap = np.c_[np.zeros(len(t)), np.diff(t, axis=1)] > LONG_GAP_MINUTES * MINUTE_US
            after = (t > end[at])[emitted]
            where = pa.array(at[emitted])
            seen = g[emitted]
            values = [table.column("subject_id").combine_chunks().take(where), t[emitted], *(v[emitted] for v in states), base[emitted], pa.array(seen, mask=np.isnan(seen)), (np.isnan(seen) & after).astype(np.int32), (gap[emitted] & after).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds)], names=names)


def with_quality(state: DataFrame, context: float, status: str) -> DataFrame:
    """Adds context_state, flags (names of the flags that are set) and status."""
    names = F.array(*(F.when(F.col(c) == 1, F.lit(name)) for c, name in (("missing_glucose", MISSING), ("long_gap", LONG_GAP))))
    return state.select("*", F.lit(context).alias("context_state"), F.array_compact(names).alias("flags"), F.lit(status).alias("status"))


def states(readings: DataFrame, parameters: Parameters = Parameters(), context: float = 0.0, status: str = "not_calibrated") -> DataFrame:
    """State after every row beyond a subject's burn-in (its first ten rows with glucose, which set the baseline);
    the baseline follows the running mean whenever the count of readings is a multiple of 100. observed is the row's own reading;
    context and status are those of the start, which nothing changes.

    readings: one row per subject and time, without NaN. Subjects with fewer than ten readings have no rows. NULL amounts are 0.
    """
    w = Window.partitionBy("subject_id").orderBy("us")
    whole = Window.partitionBy("subject_id")
    known = F.col("glucose").isNotNull()
    rows = readings.select("subject_id", "us", "glucose", "basal_insulin", "bolus_insulin", "carbohydrates", F.count("glucose").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_k"))
    early = known & (F.col("_k") <= BURN_IN)
    rows = rows.select("*", F.max(F.when(known & (F.col("_k") == BURN_IN), F.col("us"))).over(whole).alias("burn_end"), F.sum(F.when(early, F.col("glucose"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_sum"))
    rows = rows.where(F.col("burn_end").isNotNull()).withColumn("burn_mean", F.col("_sum") / float(BURN_IN)).drop("_k", "_sum")
    return with_quality(rows.sortWithinPartitions("subject_id", "us").mapInArrow(lambda it: scan(it, parameters), STATE), context, status)


def fitted_states(readings: DataFrame, parameters: Parameters = Parameters(), context: float = 0.0, status: str = "not_calibrated") -> DataFrame:
    """State from the end of the burn-in on, with the baseline of the subject's whole history: for a view of its latest
    state, not for features of earlier rows, which would know what came later.

    Needs ten rows, three of them with glucose; up to ten of those burn in. With fewer than ten the baseline is the population's.
    """
    w = Window.partitionBy("subject_id").orderBy("us")
    whole = Window.partitionBy("subject_id")
    rows = readings.select("subject_id", "us", "glucose", "basal_insulin", "bolus_insulin", "carbohydrates", F.count("glucose").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_k"), F.count("glucose").over(whole).alias("_n"), F.count("*").over(whole).alias("_rows"), F.avg("glucose").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_mean"))
    rows = rows.where((F.col("_rows") >= 10) & (F.col("_n") >= 3))
    last = F.col("glucose").isNotNull() & (F.col("_k") == F.least(F.lit(BURN_IN), F.col("_n")))
    rows = rows.select("*", F.max(F.when(last, F.col("us"))).over(whole).alias("burn_end"), F.when(F.col("_n") >= BURN_IN, F.col("_mean")).otherwise(F.lit(parameters.baseline)).alias("burn_mean")).drop("_k", "_n", "_rows", "_mean")
    return with_quality(rows.sortWithinPartitions("subject_id", "us").mapInArrow(lambda it: scan(it, parameters, None), STATE), context, status)


def clamped(value: Column, floor: float = 0.0) -> Column:
    return F.when((value > floor) & ~F.isnan(value), value).otherwise(F.lit(floor))


def path(steps: int, p: Parameters = Parameters(), carbs: Column | None = None, carbs_at: Column | None = None, bolus: Column | None = None, bolus_at: Column | None = None) -> Column:
    """Simulated glucose after each of `steps` five-minute steps from the row's state, as an array, without inputs but a
    meal or bolus at the step whose time is less than 2.5 minutes from its offset."""
    zero = F.lit(0.0)

    def given(amount: Column | None, at: Column | None, minutes: Column) -> Column:
        if amount is None:
            return zero
        near = F.abs(minutes - at) < STEP_MINUTES / 2
        return F.when(near & (amount > 0), amount).otherwise(zero)

    start = F.struct(F.col("glucose").alias("g"), F.col("insulin_action").alias("a"), F.col("insulin_state").alias("i"), F.col("meal_state").alias("m"), F.array().cast("array<double>").alias("out"))

    def advance(s: Column, k: Column) -> Column:
        minutes = (k * STEP_MINUTES).cast("double")
        absorbed = p.absorption * s["m"]
        g = clamped(s["g"] + p.drift * (F.col("baseline") - s["g"]) + p.conversion * absorbed - p.sensitivity * s["a"], 10.0)
        return F.struct(
            g.alias("g"),
            clamped(s["a"] - p.clearance * s["a"] + p.clearance * s["i"]).alias("a"),
            clamped(s["i"] - p.clearance * s["i"] + given(bolus, bolus_at, minutes)).alias("i"),
            clamped(s["m"] - absorbed + given(carbs, carbs_at, minutes)).alias("m"),
            F.array_append(s["out"], g).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda s: s["out"])


def forecast(df: DataFrame, horizon_minutes: int = 60, parameters: Parameters = Parameters()) -> DataFrame:
    """forecast: simulated glucose every five minutes up to the horizon. ValueError for a horizon below one step."""
    if horizon_minutes <= 0:
        raise ValueError("the horizon must be positive")
    return df.withColumn("forecast", path(horizon_minutes // STEP_MINUTES, parameters))


def twin_features(state: DataFrame, parameters: Parameters = Parameters(), observed: str = "observed") -> DataFrame:
    """The eighteen features of a state and its one-hour forecast, all known at the row's time. The residual is the
    column `observed` less the state's glucose, NULL without a reading."""
    d = forecast(state, 60, parameters)
    flag = lambda name: F.array_contains("flags", name).cast("double")
    g, at = F.col("glucose"), lambda k: F.get("forecast", F.lit(k))
    return d.select(
        "subject_id", "us", g.alias("twin_glucose_current"), F.col("insulin_action").alias("twin_insulin_action"), F.col("insulin_state").alias("twin_insulin_state"),
        F.col("meal_state").alias("twin_meal_state"), F.col("context_state").alias("twin_context_state"),
        *(at(k).alias(f"twin_glucose_t{m}") for m, k in ((5, 0), (15, 2), (30, 5), (60, 11))),
        ((at(5) - g) / 30.0).alias("twin_slope_30m"), ((at(11) - g) / 60.0).alias("twin_slope_60m"),
        *((at(k) - g).alias(f"twin_delta_{m}m") for m, k in ((15, 2), (30, 5), (60, 11))),
        (F.col(observed) - g).alias("twin_residual_current"), flag(LONG_GAP).alias("twin_has_long_gap"),
        flag(MISSING).alias("twin_has_missing_glucose"), F.coalesce(F.col("status") == CALIBRATED, F.lit(False)).cast("double").alias("twin_uncertainty_calibrated"),
    )


@dataclass(frozen=True)
class Scenario:
    """A change of inputs: 'baseline', 'meal_perturbation' or 'insulin_timing'."""

    kind: str = "baseline"
    amount: float | None = None
    offset_minutes: float | None = None
    description: str = ""

    def checked(self) -> Scenario:
        """ValueError unless amount and offset are given and not negative and the description claims no knowledge of
        what was observed later."""
        if self.kind not in ("baseline", "meal_perturbation", "insulin_timing"):
            raise ValueError(f"unknown scenario {self.kind}")
        if self.kind != "baseline" and any(v is None or v < 0 or math.isnan(v) for v in (self.amount, self.offset_minutes)):
            raise ValueError("amount and offset must be given and not negative")
        # fixed values: phrases a description must not hold
        for phrase in ("observed future", "actual glucose", "future label", "target"):
            if phrase in self.description.lower():
                raise ValueError(f"a description must not say '{phrase}'")
        return self


def meal(grams: float, offset_minutes: float) -> Scenario:
    return Scenario("meal_perturbation", grams, offset_minutes, f"Meal of {grams:g} after {offset_minutes:g} min").checked()


def insulin(units: float, offset_minutes: float) -> Scenario:
    return Scenario("insulin_timing", units, offset_minutes, f"Bolus of {units:g} after {offset_minutes:g} min").checked()


def what_if(state: DataFrame, scenarios: list[Scenario], horizon_minutes: int = 60, parameters: Parameters = Parameters()) -> DataFrame:
    """Each state under each scenario of a short list: (subject_id, us, scenario, baseline_path, scenario_path, delta)."""
    if horizon_minutes <= 0:
        raise ValueError("the horizon must be positive")
    steps = horizon_minutes // STEP_MINUTES
    listed = F.array(*(F.struct(F.lit(s.kind).alias("kind"), F.lit(s.description or s.kind).alias("description"), F.lit(s.amount).cast("double").alias("amount"), F.lit(s.offset_minutes).cast("double").alias("offset")) for s in (x.checked() for x in scenarios)))
    d = state.withColumn("baseline_path", path(steps, parameters)).withColumn("s", F.explode(listed))
    amount = lambda kind: F.when(F.col("s.kind") == kind, F.col("s.amount")).otherwise(0.0)
    changed = path(steps, parameters, amount("meal_perturbation"), F.col("s.offset"), amount("insulin_timing"), F.col("s.offset"))
    d = d.withColumn("scenario_path", changed)
    return d.select("subject_id", "us", F.col("s.description").alias("scenario"), "baseline_path", "scenario_path", F.zip_with("scenario_path", "baseline_path", lambda a, b: a - b).alias("delta"))


def what_if_rows(result: DataFrame, digits: int | None = 2) -> DataFrame:
    """One row per step of what_if: offset in minutes, both glucose values and their (rounded) difference."""
    d = result.select("subject_id", "us", "scenario", F.posexplode(F.arrays_zip("baseline_path", "scenario_path", "delta")).alias("k", "v"))
    delta = F.col("v.delta") if digits is None else F.round("v.delta", digits)
    return d.select("subject_id", "us", "scenario", ((F.col("k") + 1) * STEP_MINUTES).alias("offset_minutes"), F.col("v.baseline_path").alias("baseline_glucose"), F.col("v.scenario_path").alias("scenario_glucose"), delta.alias("delta"))


def at_times(state: DataFrame, targets: DataFrame) -> DataFrame:
    """States at the wanted (subject_id, us) only; what follows is then computed for those rows."""
    return state.join(targets.select("subject_id", "us").distinct(), ["subject_id", "us"], "left_semi")


def latest(state: DataFrame) -> DataFrame:
    """Last state of every subject."""
    names = [c for c in state.columns if c != "subject_id"]
    last = state.groupBy("subject_id").agg(F.max_by(F.struct(*names), "us").alias("s"))
    return last.select("subject_id", *(F.col(f"s.{c}").alias(c) for c in names))
