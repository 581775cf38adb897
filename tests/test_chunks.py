import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.batching import codes, whole_groups
from tidegrid.chunks import chunked


def rows_of(seed, hot):
    rng = random.Random(seed)
    return [("hot", rng.choice([rng.randrange(10**6), 500_000]), i) for i in range(hot)] + [(f"k{i % 7}", rng.randrange(1000), hot + i) for i in range(100)] + [(None, 5, -1)]


@pytest.mark.parametrize("target", [40, 300, 3])
def test_chunks_cover_every_row_once(spark, target):
    rows = rows_of(1, 2000)
    got = chunked(spark.createDataFrame(rows, "key string, us bigint, id bigint"), "key", "us", target).collect()
    assert Counter(r.id for r in got if r.core) == Counter(r[2] for r in rows)
    assert {r.chunk for r in got if r.key != "hot"} <= ({0} if target > 20 else set(range(100)))
    chunks = defaultdict(list)
    for r in got:
        if r.key == "hot" and r.core:
            chunks[r.chunk].append(r.us)
    ordered = [sorted(chunks[c]) for c in sorted(chunks)]
    assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:]))  # equal times are never split
    assert len(ordered) >= min(200, 2000 // target) // 3


def test_margins_are_the_neighbours(spark):
    rows = [("hot", i, i) for i in range(4096)]
    got = chunked(spark.createDataFrame(rows, "key string, us bigint, id bigint"), "key", "us", 600).collect()
    core, margin = defaultdict(set), defaultdict(set)
    for r in got:
        (core if r.core else margin)[r.chunk].add(r.us)
    assert len(core) > 4
    for c in core:
        low, high = min(core[c]), max(core[c])
        assert core[c] == set(range(low, high + 1))
        if c > 0:
            assert low - 1 in margin[c]
        if c + 1 in core:
            assert high + 1 in margin[c]
    assert sum(map(len, margin.values())) < 0.2 * len(rows)


def test_no_hot_key(spark):
    d = spark.createDataFrame(rows_of(2, 5), "key string, us bigint, id bigint")
    assert {(r.chunk, r.core) for r in chunked(d, "key", "us", 1000).collect()} == {(0, True)}
    assert chunked(d.limit(0), "key", "us", 1).count() == 0


@pytest.mark.parametrize("rows", [1, 5, 1000])
def test_whole_groups(rows):
    rng = np.random.default_rng(0)
    key = np.repeat([f"g{i:02}" for i in range(30)], rng.integers(1, 12, 30))
    table = pa.table({"k": key, "v": np.arange(len(key))})
    seen = []
    for part, run in whole_groups(iter(table.to_batches(max_chunksize=4)), ["k"], rows):
        assert (codes(part, ["k"]) == run - run[0]).all()
        seen.append(part)
    assert pa.concat_tables(seen).equals(table)
    ends = [set(p.column("k").to_pylist()) for p in seen]
    assert all(not a & b for a, b in zip(ends, ends[1:]))
    assert list(whole_groups(iter([]), ["k"])) == []
