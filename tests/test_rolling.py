import random
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, canonical
from tidegrid.operators import rolling

DAY = 1440


def brute(rows):
    """Trailing sums and counts by direct summation."""
    best = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            key = (r[1], r[2])
            if key not in best or r[0] < best[key][0]:
                best[key] = r
    days = defaultdict(lambda: defaultdict(list))
    for r in best.values():
        day = (START + timedelta(minutes=r[2])).date()
        days[r[1]][day].append(r)
    out = {}
    for s, by_day in days.items():
        first, last = min(by_day), max(by_day)
        day = first
        while day <= last:
            for p in (7, 30):
                window = [r for d, rs in by_day.items() if day - timedelta(days=p) < d <= day for r in rs]
                for k, signal in ((3, "glucose"), (4, "bolus"), (5, "carbs")):
                    values = [r[k] for r in window if r[k] is not None and r[k] == r[k] and (20 <= r[k] <= 600 if signal == "glucose" else r[k] > 0)]
                    out[s, str(day), signal, p] = (sum(values), len(values))
            day += timedelta(days=1)
    return out


def test_equals_direct_summation(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        value = lambda lo, hi: rng.choice([None, float("nan"), 0.0, -1.0] + [round(rng.uniform(lo, hi), 2)] * 6)
        rows.append((k, rng.choice(["a", "b", "c", None]), rng.choice([None] + [rng.randrange(0, 90 * DAY, 60)] * 20), value(40, 300), value(0, 5), value(0, 80)))
    rows += [(1000 + k, *r[1:3], 111.0, 1.0, 1.0) for k, r in enumerate(rows[:50])]  # later rows of the same times never count
    rng.shuffle(rows)
    want = brute(rows)
    totals = rolling.rolling_totals(canonical(spark, rows))
    got = {}
    for r in totals.collect():
        for signal in rolling.SIGNALS:
            for p in (7, 30):
                got[r.subject_id, r.day_utc, signal, p] = (r[f"{signal}_total_{p}d"], r[f"{signal}_n_{p}d"])
                average = r[f"{signal}_avg_{p}d"]
                n = r[f"{signal}_n_{p}d"]
                assert (average is None) == (n == 0)
    assert got.keys() == want.keys()
    for key, (total, n) in want.items():
        assert got[key][1] == n and got[key][0] == pytest.approx(total, abs=1e-9)
    empty = {(r.subject_id, r.day_utc, r.signal, r.period_days) for r in rolling.empty_periods(totals).collect()}
    assert empty == {k for k, (_, n) in want.items() if n == 0}


def test_odd_input(spark):
    assert rolling.rolling_totals(canonical(spark, [])).count() == 0
    rows = [(None, "s", 0, 100.0, None, None), (2, "s", 3 * DAY, None, None, None), (3, None, 0, 100.0, 1.0, 1.0), (4, "s", None, 100.0, 1.0, 1.0)]
    df = canonical(spark, rows).withColumn("day", F.lit("x")).withColumn("us", F.lit("x")).withColumn("last_day", F.lit(1)).withColumn("glucose_sum", F.lit(1))
    got = rolling.rolling_totals(df).orderBy("day_utc").collect()
    assert [r.glucose_n_7d for r in got] == [1, 1, 1, 1] and [r.carbs_n_30d for r in got] == [0] * 4


def test_window_empties_exactly(spark):
    rows = [(k, "s", k * DAY, 100.1 if k < 3 else None, None, None) for k in range(12)]
    got = rolling.rolling_totals(canonical(spark, rows)).orderBy("day_utc").collect()
    assert [r.glucose_total_7d for r in got][9:] == [0.0] * 3 and got[11].glucose_total_30d == pytest.approx(300.3)
