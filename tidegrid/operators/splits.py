"""Chronological and subject-wise splits and their leakage audit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid import schema
from tidegrid.operators.features import by_time


def _count() -> Column:
    return F.count("*").over(Window.partitionBy("subject_id"))


def two_way(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """split: the first int(n * ratio) rows of a subject train, the rest test."""
    return df.withColumn("split", F.when(F.row_number().over(by_time()) <= F.floor(_count() * F.lit(ratio)), "train").otherwise("test"))


def positional(df: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """split by place in a subject's rows, without embargo."""
    rn, n = F.row_number().over(by_time()), _count()
    return df.withColumn("split", F.when(rn <= F.floor(n * F.lit(train)), "train").when(rn <= F.floor(n * F.lit(train + validation)), "validation").otherwise("test"))


def with_embargo(df: DataFrame, train: float = 0.6, validation: float = 0.2, embargo_minutes: int = schema.EMBARGO_MINUTES) -> DataFrame:
    """split: train up to the time a of row int(n * train); validation after a plus the embargo up to the time b of row
    int(n * (train + validation)); test after b plus the embargo. Rows within an embargo are dropped.

    Where int(n * share) is 0 the boundary is the subject's last row.
    """
    whole = Window.partitionBy("subject_id")
    df = df.withColumn("_rn", F.row_number().over(by_time())).withColumn("_n", F.count("*").over(whole))
    at = lambda share: F.when(F.floor(F.col("_n") * F.lit(share)) > 0, F.floor(F.col("_n") * F.lit(share))).otherwise(F.col("_n"))
    df = df.withColumn("_a", F.max(F.when(F.col("_rn") == at(train), F.col("us"))).over(whole)).withColumn("_b", F.max(F.when(F.col("_rn") == at(train + validation), F.col("us"))).over(whole))
    gap = embargo_minutes * schema.MINUTE_US
    split = F.when(F.col("us") <= F.col("_a"), "train").when((F.col("us") > F.col("_a") + gap) & (F.col("us") <= F.col("_b")), "validation").when(F.col("us") > F.col("_b") + gap, "test")
    return df.withColumn("split", split).where(F.col("split").isNotNull()).drop("_rn", "_n", "_a", "_b")


def leak_audit(df: DataFrame, embargo_minutes: int = schema.EMBARGO_MINUTES) -> DataFrame:
    """Per subject the ends of its parts and leak_free: each part ends more than the embargo before the next begins."""
    ends = [f(F.when(F.col("split") == s, F.col("us"))).alias(f"{s}_{name}") for s in ("train", "validation", "test") for f, name in ((F.min, "first_us"), (F.max, "last_us"))]
    audit = df.groupBy("subject_id").agg(*ends)
    gap = embargo_minutes * schema.MINUTE_US
    apart = lambda a, b, g: F.coalesce(F.col(f"{a}_last_us") + g < F.col(f"{b}_first_us"), F.lit(True))
    return audit.withColumn("leak_free", apart("train", "validation", gap) & apart("validation", "test", gap) & apart("train", "test", 0))


def subject_hash(df: DataFrame, key: str = "subject_id", train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """split by a hash of the subject that other engines can compute too: the first 32 bits of MD5 of seed and id."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test"))


def subject_permutation(ids: list[str], train: float = 0.6, validation: float = 0.2, seed: int = 42, separate: bool = False) -> dict[str, str]:
    """Split of each of a list of ids short enough for the driver: the sorted ids, permuted by numpy's seeded generator, cut at the
    shares. If separate, the validation part has int(n * validation) ids instead of reaching to int(n * (train + validation))."""
    drawn = np.random.default_rng(seed).permutation(sorted(ids)).tolist()
    first = int(len(drawn) * train)
    ends = first, first + int(len(drawn) * validation) if separate else int(len(drawn) * (train + validation))
    return {s: "train" if place < ends[0] else "validation" if place < ends[1] else "test" for place, s in enumerate(drawn)}


def subject_draw(ids: list[str], n: int, seed: int = 42) -> list[str]:
    """At most n of a list of ids short enough for the driver, drawn without replacement by numpy's seeded generator from the sorted ids."""
    return np.random.default_rng(seed).choice(sorted(ids), size=min(n, len(ids)), replace=False).tolist()


def routed(df: DataFrame, split_of: DataFrame, key: str = "subject_id", default: str = "test") -> DataFrame:
    """split from a table (key, split); subjects it lacks get the default."""
    return df.join(split_of.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def sample_subjects(df: DataFrame, n: int, key: str = "subject_id", seed: int = 42) -> DataFrame:
    """n subjects drawn without replacement, in the order of a seeded hash (a sampling operator)."""
    return df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shuffled(df: DataFrame, keys: tuple[str, ...] = ("subject_id", "us"), seed: int = 42) -> DataFrame:
    """Rows in the order of a seeded hash of their keys, that other engines can compute too."""
    return df.orderBy(shuffle_key(keys, seed), *keys)


def shuffle_key(keys: tuple[str, ...] = ("subject_id", "us"), seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def resampled(df: DataFrame, member: int, seed: int = 42) -> DataFrame:
    """A bootstrap resample with replacement (each row a Poisson(1) number of times)."""
    return df.sample(withReplacement=True, fraction=1.0, seed=seed + member)
