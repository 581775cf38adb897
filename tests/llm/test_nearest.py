import random

import pytest

from tidegrid.llm.nearest import BLOCK_US, nearest

SCHEMA = "entity string, us bigint, id bigint"


def brute(left, right, tolerance):
    out = []
    for e, t, i in left:
        near = [(abs(u - t), u, j) for f, u, j in right if e is not None and f == e and t is not None and u is not None and abs(u - t) <= tolerance]
        if near:
            d, _, j = min(near)
            out.append((i, j, d))
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(0, BLOCK_US), (1, 50), (2, 40)])
def test_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    row = lambda i: (rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None] + [rng.randrange(-200, 3000)] * 30), i)
    left, right = [row(i) for i in range(600)], [row(10_000 + i) for i in range(400)]
    left += left[:20]  # repeated rows
    right += [(e, t, i + 5000) for e, t, i in right[:50]]  # equal times
    got = nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 25, block).collect()
    assert sorted(map(tuple, got)) == brute(left, right, 25)


def test_many_batches_and_ties(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left, right = [("a", t, t) for t in range(0, 1000, 3)], [("a", t, 5000 + t) for t in range(0, 1000, 10)]
        got = nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 5, 100).collect()
        assert sorted(map(tuple, got)) == brute(left, right, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    one, none = spark.createDataFrame([("a", 1, 1)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert nearest(one, none, 5).count() == nearest(none, one, 5).count() == 0
    with pytest.raises(ValueError):
        nearest(one, one, BLOCK_US + 1)


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("a", 1, 1)], SCHEMA).withColumn("side", F.lit("x")).withColumn("block", F.lit("x"))
    assert nearest(one, one, 5).first().asDict() == {"left_id": 1, "right_id": 1, "distance_us": 0}
