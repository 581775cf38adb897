from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import START
from tidegrid.operators import sync
from tidegrid.streaming import live

SCHEMA = "subject_id string, stream string, rank int, seq bigint, ts timestamp, us bigint, glucose double, basal_insulin double, bolus_insulin double, carbohydrates double"


def test_slots_equal_batch(spark, tmp_path):
    rows = [("s", "cgm", 0, i, START + timedelta(minutes=2 * i), None, 100.0 + i, None, None, 5.0 if i % 4 == 0 else None) for i in range(40)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("us", F.unix_micros("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    query = live.slots(stream).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.us, r.glucose, r.carbohydrates) for r in spark.sql("select * from slots").collect()}
    wide = d.withColumns({c: F.lit(None).cast("double") for c in ("heart_rate", "eda", "skin_temperature", "accelerometer_x", "accelerometer_y", "accelerometer_z")})
    batch = {(r.us, r.glucose, r.carbohydrates) for r in sync.synchronise(wide).collect()}
    assert got and got <= batch


def test_live_states(spark, tmp_path):
    rows = [("s", 1_000_000_000 + i * 300_000_000, 100.0 if i < 5 else None, 0.5, None, 20.0 if i == 6 else None) for i in range(10)]
    d = spark.createDataFrame(rows, "subject_id string, us bigint, glucose double, basal_insulin double, bolus_insulin double, carbohydrates double")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    query = live.live_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select * from states order by us").collect()
    assert len(got) == 10 and got[4].glucose == 100 and got[6].meal_state == 20 and got[9].glucose >= 10
