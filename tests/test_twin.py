import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import START_US, readings
from tidegrid.operators import twin

MIN = 60_000_000
PATH = [110.0, 109.925, 109.795, 109.6264375, 109.43271875, 109.22467828, 109.01097581, 108.79843852, 108.59235569, 108.39673187, 108.21450404, 108.04772730]


def state(spark):
    return spark.createDataFrame([("s", START_US, 110.0, 0.5, 1.0, 5.0, 110.0, 110.0, 0, 0)], twin.STATE)


def test_forecast(spark):
    got = twin.forecast(state(spark), 60).first().forecast
    assert got == pytest.approx(PATH, abs=1e-7) and twin.forecast(state(spark), 30).first().forecast == got[:6]
    with pytest.raises(ValueError):
        twin.forecast(state(spark), 0)


def test_forecast_equals_steps(spark):
    now, want = (110.0, 0.5, 1.0, 5.0), []
    for _ in range(12):
        now = twin.step(now, None, 0.0, 0.0, 0.0, 5.0, 110.0, twin.Parameters())
        want.append(now[0])
    assert twin.forecast(state(spark)).first().forecast == want


def test_twenty_readings_give_ten_rows(spark):
    d = twin.states(readings(spark, [{"minutes": 5 * i, "glucose": 100.0} for i in range(20)])).orderBy("us").collect()
    assert [(r.us - START_US) // MIN for r in d] == list(range(50, 100, 5)) and {r.baseline for r in d} == {100.0}
    f = twin.twin_features(twin.states(readings(spark, [{"minutes": 5 * i, "glucose": 100.0} for i in range(20)]))).first()
    assert len(f) == 20 and f.twin_residual_current == 0 and f.twin_slope_30m == pytest.approx((f.twin_glucose_t30 - 100) / 30)


def test_short_and_missing(spark):
    assert twin.states(readings(spark, [{"minutes": 5 * i, "glucose": 100.0 if i % 2 else None} for i in range(18)])).count() == 0
    rows = [{"minutes": 5 * i, "glucose": 100.0, "bolus_insulin": 5.0 if i == 3 else None} for i in range(10)]
    rows += [{"minutes": 50, "carbohydrates": 30.0}, {"minutes": 80}, {"minutes": 85, "glucose": 90.0}]
    a, b, c = twin.states(readings(spark, rows)).orderBy("us").collect()
    assert (a.missing_glucose, b.missing_glucose, c.missing_glucose) == (1, 1, 0) and (a.long_gap, b.long_gap, c.long_gap) == (0, 1, 0)
    assert (a.flags, b.flags, c.flags) == (["MISSING_GLUCOSE"], ["MISSING_GLUCOSE", "LONG_GAP"], [])
    features = twin.twin_features(twin.states(readings(spark, rows), context=0.5, status="calibrated")).orderBy("us").collect()
    assert [f.twin_residual_current for f in features] == [None, None, 0.0] and [f.twin_has_long_gap for f in features] == [0.0, 1.0, 0.0]
    assert {(f.twin_context_state, f.twin_uncertainty_calibrated) for f in features} == {(0.5, 1.0)}
    assert a.meal_state == 30 and b.meal_state == pytest.approx(28.5) and c.glucose == 90 and a.glucose >= 10
    assert twin.states(readings(spark, [])).count() == 0


def test_baseline_follows_every_hundred(spark):
    d = twin.states(readings(spark, [{"minutes": 5 * i, "glucose": 100.0 + (i >= 50) * 20} for i in range(120)])).orderBy("us").collect()
    assert {r.baseline for r in d[:89]} == {100.0} and {r.baseline for r in d[89:]} == {110.0}


def test_future_does_not_matter(spark):
    rows = [{"minutes": 5 * i, "glucose": 100.0 + i % 7, "carbohydrates": 10.0 if i % 9 == 0 else None} for i in range(40)]
    a = twin.states(readings(spark, rows)).where(F.col("us") < START_US + 150 * MIN).orderBy("us").collect()
    rows[35]["glucose"] = 40.0
    assert a == twin.states(readings(spark, rows)).where(F.col("us") < START_US + 150 * MIN).orderBy("us").collect()


def test_what_if(spark):
    out = twin.what_if(state(spark), [twin.Scenario(), twin.meal(50, 15), twin.insulin(2, 10)], 60).collect()
    plain, meal, bolus = out
    assert plain.delta == [0.0] * 12 and len(meal.scenario_path) == 12
    assert meal.delta[:3] == [0, 0, 0] and meal.delta[3] == pytest.approx(5.0) and min(bolus.delta) < 0
    for r in out:
        assert all(abs(c - b - x) < 1e-9 for c, b, x in zip(r.scenario_path, r.baseline_path, r.delta)) and min(r.scenario_path) >= 10
    # an offset no step is near to never takes effect
    assert twin.what_if(state(spark), [twin.meal(50, 2.5), twin.meal(50, 7.5)]).select("delta").distinct().first().delta == [0.0] * 12
    assert twin.what_if_rows(twin.what_if(state(spark), [twin.meal(50, 15)], 30)).count() == 6


@pytest.mark.parametrize("bad", [("meal_perturbation", None, 5.0, ""), ("meal_perturbation", 5.0, None, ""), ("insulin_timing", -1.0, 5.0, ""), ("other", 1.0, 1.0, ""), ("meal_perturbation", 1.0, 1.0, "Fits the target")])
def test_scenarios_are_checked(bad):
    with pytest.raises(ValueError):
        twin.Scenario(*bad).checked()


def test_stays_finite(spark):
    rows = [{"minutes": 5 * i, "glucose": 100.0 if i < 10 else None, "bolus_insulin": 3.0} for i in range(210)]
    assert twin.states(readings(spark, rows)).where("glucose < 10 or isnan(glucose) or insulin_state < 0").count() == 0


def test_fitted_states(spark):
    rows = [{"minutes": 5 * i, "glucose": 100.0 + i} for i in range(20)] + [{"subject_id": "few", "minutes": 5 * i, "glucose": 90.0 if i in (2, 4, 6) else None} for i in range(12)]
    rows += [{"subject_id": "none", "minutes": 5 * i, "glucose": 90.0 if i < 2 else None} for i in range(12)] + [{"subject_id": "short", "minutes": 5 * i, "glucose": 90.0} for i in range(9)]
    d = twin.fitted_states(readings(spark, rows))
    got = {r.subject_id: r for r in twin.latest(d).collect()}
    assert set(got) == {"s", "few"} and got["s"].baseline == 109.5 and got["few"].baseline == 110.0 and got["few"].missing_glucose == 1
    assert d.where("subject_id = 's'").count() == 11 and d.where("subject_id = 'few'").count() == 6
    assert twin.at_times(d, d.where("subject_id = 'few'").limit(2)).count() == 2


def test_update():
    start = twin.State(START_US, 120.0, context_state=0.3)
    assert twin.update(start, START_US, 50.0) is start
    with pytest.raises(ValueError):
        twin.update(start, START_US - 1, 50.0)
    gap = twin.update(start, START_US + 20 * MIN, None, carbs=10.0)
    assert gap.flags == ("MISSING_GLUCOSE", "LONG_GAP") and gap.meal_state == 10 and gap.context_state == 0.3
    seen = twin.update(gap, gap.us + 15 * MIN, 101.0, bolus=2.0)
    assert seen.flags == () and seen.glucose == 101 and seen.insulin_state == 2 and seen.meal_state == pytest.approx(9.5)
    assert twin.update(seen, seen.us + MIN, float("nan")).flags == ("MISSING_GLUCOSE",)


def test_update_equals_the_scan(spark):
    rows = [{"minutes": 5 * i + (20 if i > 30 else 0), "glucose": 100.0 + i if i % 3 else None, "carbohydrates": 12.0 if i % 5 == 0 else None, "bolus_insulin": 1.5 if i % 7 == 0 else None, "basal_insulin": 0.8} for i in range(50)]
    got = twin.states(readings(spark, rows)).orderBy("us").collect()
    now = None
    for r in rows:
        us = START_US + int(r["minutes"] * MIN)
        if us < got[0].us:
            if r["glucose"] is None:
                continue
            now = twin.State(us, r["glucose"]) if now is None else twin.update(now, us, r["glucose"], r["carbohydrates"], r["bolus_insulin"], r["basal_insulin"])
            continue
        now = twin.update(now, us, r["glucose"], r["carbohydrates"], r["bolus_insulin"], r["basal_insulin"], baseline=got[0].baseline)
        row = next(g for g in got if g.us == us)
        assert (row.glucose, row.insulin_action, row.insulin_state, row.meal_state, tuple(row.flags)) == (now.glucose, now.insulin_action, now.insulin_state, now.meal_state, now.flags)


@pytest.mark.parametrize("narrow", [1, 8, 100])
def test_lock_step_equals_single_steps(monkeypatch, narrow):
    """Many subjects of different lengths at once against one step after the other."""
    monkeypatch.setattr(twin, "NARROW", narrow)
    rng = np.random.default_rng(1)
    length = np.array(sorted([int(n) for n in rng.integers(1, 60, 30)] + [200], reverse=True))
    shape = len(length), length[0]
    us = np.cumsum(rng.integers(1, 30, shape), axis=1) * MIN
    glucose = np.where(rng.random(shape) < 0.3, np.nan, rng.uniform(50, 250, shape))
    glucose[:, 0] = 100.0
    carbs, bolus, basal = (np.where(rng.random(shape) < 0.1, rng.uniform(-1, high, shape), 0.0) for high in (60, 5, 2))
    baseline = rng.uniform(90, 140, shape)
    got = twin.advanced(length, us, glucose, carbs, bolus, basal, baseline, twin.Parameters())
    for r, n in enumerate(length):
        state = (100.0, 0.0, 0.0, 0.0)
        for k in range(1, n):
            seen = None if np.isnan(glucose[r, k]) else glucose[r, k]
            state = twin.step(state, seen, carbs[r, k], bolus[r, k], basal[r, k], (us[r, k] - us[r, k - 1]) / MIN, baseline[r, k], twin.Parameters())
            assert tuple(v[r, k] for v in got) == state
