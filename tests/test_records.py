import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import START_US, readings
from tidegrid import schema
from tidegrid.operators import features, joins, profile, splits, sync
from tidegrid.sources import adapters, generated, parquet, sinks, xml
from tidegrid.plans.stores import XML_SAMPLE

MIN = 60_000_000
GAPPY = [(0, 100), (5, 98), (10, None), (15, None), (20, None), (25, 80), (30, 79), (35, 60), (215, 55), (220, 120), (250, None), (255, 130)]


def gappy(spark):
    return readings(spark, [{"minutes": m, "glucose": None if g is None else float(g)} for m, g in GAPPY])


def values(df, column, digits=4):
    return [None if r[0] is None else round(r[0], digits) for r in df.orderBy("us").select(column).collect()]


def test_gappy_series(spark):
    d = features.glucose_features(gappy(spark))
    assert values(d, "glucose_current", 3) == [100, 98, 93.5, 89.0, None, 80, 79, 60, 55, 120, 128.571, 130]
    raw = gappy(spark).select("*", F.avg("glucose").over(features.back(30)).alias("m"), F.stddev_samp("glucose").over(features.back(30)).alias("sd"), F.first("glucose").over(features.by_time().rangeBetween(-5 * MIN, -5 * MIN)).alias("lag"))
    assert values(raw, "m") == [100, 99, 99, 99, 99, 92.6667, 85.6667, 73, 55, 87.5, None, 130]
    assert values(raw, "sd") == [None, 1.4142, 1.4142, 1.4142, 1.4142, 11.0151, 10.6927, 11.2694, None, 45.9619, None, None]
    assert values(raw, "lag") == [None, 100, 98, None, None, None, 80, 79, None, 55, None, None]
    labels = features.with_labels(gappy(spark))
    assert values(labels, "future_hypoglycemia_30m") == [0, 1, 1, 1, 1, 1, 1, 1, 0, None, 0, None]
    strict = features.with_labels(gappy(spark), strict=True)
    assert values(strict, "future_hypoglycemia_30m") == [0, 1, 1, 1, 1, 1, 1, None, 0, None, 0, None]


def test_trailing_and_leading_gaps(spark):
    rows = [{"subject_id": "t", "minutes": 5 * i, "glucose": 100.0 if i == 0 else None} for i in range(4)]
    rows += [{"subject_id": "l", "minutes": 5 * i, "glucose": 100.0 if i == 2 else None} for i in range(3)]
    d = features.interpolated(readings(spark, rows))
    assert values(d.where("subject_id = 't'"), "glucose_current") == [100, 100, 100, None]
    assert values(d.where("subject_id = 'l'"), "glucose_current") == [None, None, 100]
    assert values(features.interpolated(gappy(spark), causal=True), "glucose_current") == [100, 98, 98, 98, None, 80, 79, 60, 55, 120, 120, 130]


def descending(spark, changed=None):
    rows = [{"minutes": 5 * i, "glucose": 100.0 - 2 * i, "basal_insulin": 0.5, "bolus_insulin": 1.0 if i == 2 else None, "carbohydrates": 20.0 if i == 5 else None, "heart_rate": 70.0, "eda": 0.1, "skin_temperature": 36.5, "accelerometer_x": 0.0, "accelerometer_y": 1.0, "accelerometer_z": 0.0} for i in range(20)]
    if changed:
        rows[changed[0]]["glucose"] = changed[1]
    return features.all_features(readings(spark, rows))


def test_future_changes_labels_only(spark):
    at = START_US + 25 * MIN
    a = descending(spark).where(F.col("us") == at).first().asDict()
    b = descending(spark, (10, 40.0)).where(F.col("us") == at).first().asDict()
    assert all(k.startswith("future_") for k in a if a[k] != b[k])
    assert (a["future_severe_hypoglycemia_30m"], b["future_severe_hypoglycemia_30m"]) == (0, 1)
    assert a["minutes_since_bolus"] == 15 and a["minutes_since_meal"] == 0 and a["acc_magnitude"] == 1 and a["basal_current"] == 0.5 and a["insulin_bolus_last_30m"] == 1


def test_missing_columns_are_skipped(spark):
    d = features.all_features(gappy(spark).select("subject_id", "us", "glucose"))
    assert "glucose_roc_5m" in d.columns and "carbs_recent" not in d.columns and d.count() == len(GAPPY)
    assert features.all_features(readings(spark, [])).count() == 0


def records(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.STREAM_RECORD) for r in rows], schema.STREAM_RECORD)


def test_synchronise(spark):
    row = lambda stream, seq, minutes, **v: {"subject_id": "s", "stream": stream, "rank": schema.STREAMS.index(stream), "seq": seq, "us": START_US + int(minutes * MIN), **v}
    rows = [
        row("cgm", 1, 1), row("cgm", 2, 2, glucose=120.0), row("cgm", 3, 3, glucose=125.0), row("insulin", 4, 2, bolus_insulin=2.0), row("insulin", 5, 4, bolus_insulin=3.0),
        row("wearable", 6, 1, eda=0.1), row("wearable", 7, 2, heart_rate=70.0, eda=0.2), row("wearable", 8, 3, heart_rate=80.0, eda=0.3),
        row("wearable", 9, 6, eda=0.4), row("wearable", 10, 7, eda=0.5, skin_temperature=33.0),
    ]
    a, b = sync.synchronise(records(spark, rows)).orderBy("us").collect()
    assert (a.us, a.glucose, a.bolus_insulin, a.heart_rate, a.eda) == (START_US, 120.0, 2.0, 70.0, 0.2)
    assert (b.us - a.us, b.glucose, b.heart_rate, b.eda, b.skin_temperature) == (5 * MIN, None, None, 0.5, 33.0)
    assert sync.synchronise(records(spark, rows), total_amounts=True).orderBy("us").first().bolus_insulin == 5.0


def test_quality_and_validation(spark):
    row = lambda seq, minutes, g, **k: {"subject_id": "s", "stream": "cgm", "rank": 0, "seq": seq, "us": START_US + minutes * MIN, "glucose": g, **k}
    d = records(spark, [row(1, 5, 110.0), row(2, 0, 100.0), row(3, 0, 105.0), row(4, 9, -10.0)])
    first = sync.first_of_each_time(d).orderBy("us").collect()
    assert [r.glucose for r in first] == [100.0, 110.0, -10.0]
    assert [r.glucose for r in sync.without_negatives(d).orderBy("seq").collect()] == [110, 100, 105, None]
    found = sync.validation(d).orderBy("seq").collect()
    assert [(r.seq, r.message) for r in found] == [(2, "Non-chronological ordering"), (3, "Duplicate timestamp"), (4, "Negative glucose value")]
    many = records(spark, [row(i, 5 * (i % 50), 1.0) for i in range(400)])
    assert sync.validation(many, target_rows=40).count() == sync.validation(many).count() == 7
    assert sync.validity(d).first().asDict() == {"n_subjects": 1, "n_errors": 2, "n_warnings": 1, "valid": False}
    assert sync.plausible(readings(spark, [{"minutes": i, "glucose": g} for i, g in enumerate((1.0, 15.0, 100.0, 700.0, 300.0, None))])).count() == 2


def test_splits(spark):
    d = readings(spark, [{"minutes": 5 * i, "glucose": 100.0} for i in range(300)])
    e = splits.with_embargo(d)
    ends = {r.split: (r.lo, r.hi) for r in e.groupBy("split").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).collect()}
    assert ends["train"][1] + 60 * MIN < ends["validation"][0] and ends["validation"][1] + 60 * MIN < ends["test"][0]
    assert splits.leak_audit(e).first().leak_free and not splits.leak_audit(splits.positional(d)).first().leak_free
    assert splits.two_way(d).where("split = 'train'").count() == 240
    ids = [f"s{i}" for i in range(100)]
    parts = splits.subject_permutation(ids)
    assert len(parts) == 100 and parts == splits.subject_permutation(ids[::-1]) and sorted(parts.values()).count("train") == 60
    assert sorted(splits.subject_permutation(ids[:33], 0.7, 0.15, separate=True).values()).count("validation") == 4
    assert len(set(splits.subject_draw(ids, 50))) == 50 and splits.subject_draw(ids[:3], 50) and splits.subject_permutation([]) == {}
    frame = spark.createDataFrame([(i,) for i in ids], "subject_id string")
    assert splits.subject_hash(frame).collect() == splits.subject_hash(frame).collect()
    assert {r.split for r in splits.routed(frame, frame.limit(3).withColumn("split", F.lit("train"))).collect()} == {"train", "test"}
    assert splits.sample_subjects(frame, 50).count() == 50
    trimmed = features.trimmed(d.withColumn("label", F.lit(1.0)), ["label"])
    assert trimmed.count() == 300 - 24 and features.large_enough(d, ["glucose"]).count() == 300 and features.large_enough(d.limit(40), ["glucose"]).count() == 0


def test_adapter(spark):
    d = spark.createDataFrame([("1", "2026-01-01 00:00:00", 100.0, "x"), ("2", "2026-01-01 00:05:00", float("nan"), "y")], "id string, date string, CGM double, extra string")
    got = adapters.canonical(d).orderBy("subject_id").collect()
    assert [r.glucose for r in got] == [100.0, None] and "extra" not in got[0].asDict() and got[0].basal is None
    assert adapters.canonical(d.drop("id")).count() == 0
    seen = {(r.keyword, r.status) for r in parquet.semantic_columns(d).collect()}
    assert ("CGM", "CONFIRMED") in seen and ("sleep", "NOT FOUND") in seen and ("id", "CONFIRMED") in seen
    wanted = spark.createDataFrame([("1",)], "id string")
    assert adapters.of_subjects(d, wanted, "id").count() == adapters.of_subjects(d, wanted, "id", max_rows=0).count() == 1


def test_xml(spark, tmp_path):
    (tmp_path / "A7.xml").write_text(XML_SAMPLE)
    (tmp_path / "B2.xml").write_text("<patient")
    assert xml.discover(spark, str(tmp_path)) == ["A7", "B2"] and xml.discover(spark, str(tmp_path / "none")) == []
    d = xml.load(spark, str(tmp_path), "A7")
    assert {r.stream: r["count"] for r in d.groupBy("stream").count().collect()} == {"cgm": 2, "insulin": 2, "meal": 1, "wearable": 1}
    a, b = sync.synchronise(d).orderBy("us").collect()
    assert (a.glucose, a.basal_insulin, a.heart_rate, a.eda) == (96.5, 0.85, 64, None) and (b.glucose, b.bolus_insulin, b.carbohydrates) == (101, 3.25, 48)
    assert xml.load(spark, str(tmp_path), "B2").count() == 0
    assert sorted(xml.load_all(spark, str(tmp_path)).collect()) == sorted(d.collect())
    odd = d.withColumn("subject_id", F.lit('a<b & "c"'))
    xml.rendered(odd).select("xml").write.text(str(tmp_path / "more"))
    assert {r.subject_id for r in xml.load_all(spark, str(tmp_path / "more")).collect()} == {'a<b & "c"'}
    with pytest.raises(FileNotFoundError):
        xml.load(spark, str(tmp_path), "1")
    with pytest.raises(Exception, match="unreadable time"):
        xml.parse(spark.createDataFrame([("1", '<patient><meal><event ts="soon" carbs="1"/></meal></patient>')], "subject_id string, xml string")).collect()


def test_sinks(spark, tmp_path):
    d = readings(spark, [{"minutes": i, "glucose": 100.0 + i} for i in range(5)])
    sinks.write_subject_csv(d.select("subject_id", "us", "glucose"), str(tmp_path / "csv"))
    assert (tmp_path / "csv" / "subject_id=s").exists()
    both = sinks.align([d.select("us", "glucose"), d.select("us", "eda")])
    assert set(both.columns) == {"us", "glucose", "eda"} and both.count() == 10
    sinks.write_chunks(d.withColumn("split", F.lit("train")).withColumn("horizon", F.lit("30m")), str(tmp_path / "chunks"))
    back = sinks.read_chunks(spark, str(tmp_path / "chunks"), "train", "30m")
    assert back.count() == 5 and dict(back.dtypes)["glucose"] == "float"
    assert sinks.guarded_json({"calibration": {"x": [1] * 101}, "y": [1]})
    with pytest.raises(ValueError, match="101"):
        sinks.guarded_json({"a": {"b": [0] * 101}})


def test_profiles_of_odd_input(spark):
    d = spark.createDataFrame([], "subject_id string, timestamp timestamp_ntz, glucose double, insulin double, basal double, bolus double, carbs double")
    manifest = profile.cohort(d)
    assert manifest.count() == 0 and profile.cohort_stats(manifest).first().core_median_days is None
    assert profile.glucose_profile(d).first().pct_below_70 is None and profile.additivity(d).first().n == 0
    assert profile.missing(d, ["glucose", "subject_id"]).count() == 2
    assert profile.quality(gappy(spark)).first().n_gaps_over_10m == 2


def test_generated_frame(spark):
    d = generated.modelling_frame(spark, 500)
    assert d.count() == 500 and {r[0] for r in d.select("future_hypoglycemia_30m").distinct().collect()} == {0.0, 1.0, None}
    wide = generated.ablation_frame(spark)
    assert wide.count() == 1000 and len(wide.columns) == 1 + 15 + 18 + 2 and wide.collect() == generated.ablation_frame(spark).collect()
    assert wide.where("(glucose_current < 80 or twin_glucose_t30 < 80) != (future_hypoglycemia_30m = 1)").count() == 0
    assert generated.smoke_readings(spark).where("bolus_insulin > 0 or carbohydrates > 0").count() == 2
    names, clean = features.sanitised(d.withColumn("bad", F.lit(math.inf)), "future_hypoglycemia_30m")
    assert "bad" in names and not any(n.startswith("future_") for n in names) and clean.where("bad is not null").count() == 0


def test_demo(spark):
    d = generated.demo_readings(spark)
    assert d.count() == 72 and d.collect() == generated.demo_readings(spark).collect()
    row = profile.quality(d).first()
    assert (row.n_records, row.meal_records, row.insulin_records, row.cgm_availability_pct) == (72, 1, 72, 100.0) and 40 <= row.min_glucose < row.max_glucose


def test_joins(spark, tmp_path):
    a = readings(spark, [{"minutes": 5 * i, "glucose": 100.0 + i} for i in range(6)]).select("subject_id", "us", "glucose")
    b = a.where("glucose > 102").select("subject_id", "us", (F.col("glucose") * 2).alias("double"), F.lit(0.0).alias("glucose"))
    assert [(r.glucose, r.double) for r in joins.with_features(a, b).orderBy("us").collect()] == [(100, None), (101, None), (102, None), (103, 206), (104, 208), (105, 210)]
    assert joins.with_features(a, b.limit(0)).where("double is null").count() == 6
    left = spark.range(0, 50).select((49 - F.col("id")).alias("x")).repartition(3)
    right = spark.range(100, 140).withColumnRenamed("id", "y").repartition(5)
    pairs = joins.side_by_side(left, right, ("x",), ("y",)).collect()
    assert sorted((r.x, r.y) for r in pairs if r.y) == [(i, 100 + i) for i in range(40)] and len(pairs) == 50
    assert joins.side_by_side(left.limit(0), right.limit(0), ("x",), ("y",)).count() == 0
    got = a.select("us", joins.at_lag("glucose", 10).alias("lag"), joins.last_time(F.col("glucose") == 101).alias("t")).orderBy("us").collect()
    assert [r.lag for r in got] == [None, None, 100, 101, 102, 103] and got[0].t is None and got[5].t == got[1].us
    a.write.parquet(str(tmp_path / "p"))
    assert parquet.sql_over(spark, str(tmp_path / "p"), "select count(*) as n from {rows} where glucose > 102").first().n == 3
