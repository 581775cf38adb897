import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import canonical
from tidegrid.functions.forest import average_path, forest_scores
from tidegrid.operators import spikes


def source(seed, n=500):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 5.0
    return t, np.round(130 + 40 * np.sin(t / 200) + rng.normal(0, 2, n), 1)


def planted():
    """Rows and the record ids that must be found."""
    rows, bad, k = [], set(), 0
    for s in ("a", "b"):
        t, y = source(ord(s))
        heart, skin = np.round(70 + np.random.default_rng(1).normal(0, 2, len(t)), 1), np.round(33 + np.random.default_rng(2).normal(0, 0.1, len(t)), 2)
        y[100:102] += 90  # leaps away and comes back
        y[200] -= 80
        y[300:315] = 131.3  # frozen
        y[350] = 9999.0
        y[360:364] = np.round(y[360:364] / 18.016, 1)  # another unit
        y[420:] += 60  # a sustained rise
        heart[50] = 0.0
        heart[150:153] += 70
        skin[80:95] = 33.07
        skin[250] = 91.4
        for i in range(len(t)):
            k += 1
            rows.append((k, s, float(t[i]), float(y[i]), None, None, float(heart[i]), float(skin[i])))
            if i in (100, 101, 200, 350, *range(300, 315), *range(360, 364)):
                bad.add((k, "glucose"))
            if i in (50, 150, 151, 152):
                bad.add((k, "heart_rate"))
            if i in (250, *range(80, 95)):
                bad.add((k, "skin_temperature"))
    return rows, bad


def test_scores_do_not_depend_on_the_company():
    rng = np.random.default_rng(4)
    x = rng.random((500, 4))
    x[:, 3] = 0  # says nothing
    group = np.repeat([0, 1, 2], [200, 5, 295])
    train, seeds = rng.random(500) < 0.8, np.array([11, 12, 13])
    whole = forest_scores(x, group, train, seeds=seeds)
    alone = forest_scores(x[205:], np.zeros(295, int), train[205:], seeds=seeds[2:])
    assert (whole[205:] == alone).all() and len(set(whole)) > 100


def test_finds_planted(spark):
    rows, bad = planted()
    found = {(r.record_id, r.signal) for r in spikes.implausible(canonical(spark, rows)).collect()}
    assert bad <= found and len(found - bad) <= 2


def test_scores_every_reading(spark):
    rows, bad = planted()
    got = spikes.score_readings(canonical(spark, rows)).collect()
    assert len(got) == 3 * len(rows) and all(0 < r.score < 1 for r in got)
    flagged = [r.score for r in got if r.rule is not None]
    assert np.median(flagged) > np.median([r.score for r in got if r.rule is None])


def test_hot_sources_are_split_without_loss(spark):
    rows, bad = planted()
    df = canonical(spark, rows)
    whole = spikes.score_readings(df).select("record_id", "signal").collect()
    split = spikes.score_readings(df, target_rows=150).select("record_id", "signal").collect()
    assert sorted(whole) == sorted(split)
    found = {(r.record_id, r.signal) for r in spikes.score_readings(df, only_flagged=True, target_rows=150).collect()}
    assert bad <= found and len(found - bad) <= 2


def test_the_forest_decides(spark, monkeypatch):
    """Without the forest readings are flagged that it clears; with a forest that clears all, only the limits are left."""
    rng = np.random.default_rng(3)
    t, y = source(8, 3000)
    y = np.round(y + np.where(rng.random(3000) < 0.02, rng.choice([-12, 12], 3000), 0), 1)  # unrest that is usual for this source
    y[[700, 1500]] += 120
    y[900] = 5000.0
    frame = np.zeros(len(t), np.int64), (t * 60e6).astype(np.int64), y
    _, rule = spikes.judge("glucose", *frame)
    _, open_ = spikes.judge("glucose", *frame, odd=0.0)
    _, shut = spikes.judge("glucose", *frame, odd=1.1)
    assert set(np.flatnonzero(shut)) == {900} and {700, 900, 1500} <= set(np.flatnonzero(rule))
    assert (open_ > 0).sum() > 2 * (rule > 0).sum()


def test_switching_the_forest_off_changes_what_is_found(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    rows = spark.read.parquet(f"{folder}/canonical_records.parquet")
    found = set(spikes.implausible(rows).collect())
    monkeypatch.setattr(spikes, "ODD", 0.0)
    without = set(spikes.implausible(rows).collect())
    assert found < without and len(without) >= 1.05 * len(found)


def test_repeats_and_corrections(spark):
    t, y = source(5)
    y[100] += 100
    rows = [(i + 1, "a", float(t[i]), float(y[i])) for i in range(len(t))]
    rows += [(1001, "a", float(t[100]), float(y[100])), (1002, "a", float(t[100]), float(y[100] - 100)), (1003, "a", float(t[101]), float(y[101]))]
    found = {r.record_id for r in spikes.implausible(canonical(spark, rows)).collect()}
    assert {101, 1001} <= found and 1002 not in found and 1003 not in found


def test_odd_input(spark):
    assert spikes.score_readings(canonical(spark, [])).count() == 0
    rows = [(1, None, 0, 9999.0), (2, "s", None, 9999.0), (3, "s", 0, None), (4, "s", 1, float("nan")), (5, "one", 0, -5.0), (None, "two", 0, 100.0), (7, "inf", 0, float("inf"))]
    df = canonical(spark, rows).withColumn("chunk", F.lit("x")).withColumn("core", F.lit("x")).withColumn("us", F.lit(0)).withColumn("cell", F.lit(0)).withColumn("rule", F.lit("x"))
    got = {(r.record_id, r.rule) for r in spikes.score_readings(df).collect()}
    assert got == {(5, "impossible"), (None, None), (7, "impossible")}


def test_source_in_another_unit(spark):
    t, y = source(6)
    rows = [(i, "mmol", float(t[i]), round(float(y[i]) / 18.016, 2)) for i in range(200)] + [(999, "mmol", 5000.0, 120.0)]
    rows += [(2000 + i, "broken", float(t[i]), 100.0 + i % 3 if i < 15 else 1.0 + i % 7 / 10) for i in range(60)]
    found = {r.record_id for r in spikes.implausible(canonical(spark, rows)).collect()}
    assert 999 in found and found - {999} == set(range(2015, 2060))


def test_constant_source(spark):
    rows = [(i, "s", 5.0 * i, 100.0) for i in range(40)]
    assert {r.rule for r in spikes.score_readings(canonical(spark, rows)).collect()} <= {"frozen", None}


def test_forest_prefers_the_outlier():
    rng = np.random.default_rng(0)
    x = 0.4 + 0.1 * rng.random((600, 3))
    x[10] = 0.95
    x[400] = 0.02
    group = np.repeat([0, 1], 300)
    score = forest_scores(x, group, np.ones(600, bool))
    assert score[:300].argmax() == 10 and score[300:].argmax() == 100
    assert forest_scores(x, group, np.zeros(600, bool)).tolist() == [0.5] * 600
    assert average_path(2) == 1 and average_path(1) == 0 and 10 < average_path(256) < 11


def test_a_chunk_is_judged_by_its_whole_source(spark):
    rng, n = np.random.default_rng(7), 12_000
    y = np.round(130 + 40 * np.sin(np.arange(n) / 300) + rng.normal(0, 2, n), 1)
    y[7000:] = np.round(y[7000:] + rng.normal(0, 12, n - 7000), 1)  # restless: the source's steps aren't the chunk's
    y[500:4500] = np.round(y[500:4500] / 18.016, 1)  # another unit in more than half of a chunk
    y[[100, 5600, 8000, 11000]] += 150
    y[5800:5830] = 131.3
    rows = [(i, "hot", 5.0 * i, float(v), None, None, round(70 + float(h), 1), None) for i, (v, h) in enumerate(zip(y, rng.normal(0, 2, n)))]
    rows += [(n + i, "hot", 5.0 * i, float(y[i])) for i in range(0, n, 97)] + [(2 * n + i, "cold", 5.0 * i, 100.0 + i % 9) for i in range(50)]
    df = canonical(spark, rows)
    result = lambda target: sorted((r.record_id, r.signal, round(r.score, 9), r.rule or "") for r in spikes.score_readings(df, target_rows=target).collect())
    whole, split = result(50_000), result(3000)
    assert whole == split
    assert {i for i, s, _, rule in split if s == "glucose" and rule} >= {*range(500, 4500), 100, 5600, *range(5800, 5830)}
