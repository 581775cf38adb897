import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import canonical
from tidegrid.llm.components import connected_components
from tidegrid.llm.splits import anneal, person_pairs, person_splits, plain_id

SUBJECTS = "subject_id string, person_ref string, prior_subject_id string, site string"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(200)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"h{i:03}") for i in range(60)] + [("alone", "alone"), ("x", None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == union_find([e for e in edges if e[1]])
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_plain_id(spark):
    cases = {"GL_0202788": "GL202788", " gl-202788\t": "GL202788", "GL–202788": "GL202788", "0215233": "215233", "215233.0": "215233", "PR.3000030": "PR3000030", "PR-0000000": None, "none": None, "": None, "-": None, "n/a": None, "PR3 ": "PR3", "K 211 852": "K211852", "１２": "12"}
    d = spark.createDataFrame([(c,) for c in cases], "c string").select("c", plain_id("c").alias("p"))
    assert {r.c: r.p for r in d.collect()} == cases


def world(spark):
    names = ["100", "0100", "100.0", "B-200", "b 200", "300", "400", "500", "600", "x", "700"]
    rows, k = [], 0
    for n, name in enumerate(names):
        for i in range(10 + 7 * n):
            rows.append(((k := k + 1), name, float(i), 60.0 if i % (n + 2) == 0 else 120.0))
    rows.append((9999, None, 0.0, 100.0))
    subjects = [("100", "PR-1", None, "a"), ("B-200", "pr 1", None, "b"), ("300", "unknown", None, None), ("400", "unknown", "0300", None), ("500", None, "old-77", None), ("600", None, "OLD 77", None), ("600", None, "600", None), (None, "PR-1", "700", None), ("700", "PR-0", "none", None)]
    return canonical(spark, rows), spark.createDataFrame(subjects, SUBJECTS)


def test_persons_stay_together(spark):
    records, subjects = world(spark)
    splits = person_splits(records.withColumn("component", F.lit("x")).withColumn("n_rows", F.lit(1)), subjects.withColumn("split", F.lit("x")), rounds=1)
    rows = {r.subject_id: r for r in splits.collect()}
    assert len(rows) == 11 and None not in rows
    groups = [{"100", "0100", "100.0", "B-200", "b 200"}, {"300", "400"}, {"500", "600"}, {"x"}, {"700"}]
    for g in groups:
        assert len({rows[x].component for x in g}) == 1 and len({rows[x].split for x in g}) == 1
    assert len({r.component for r in rows.values()}) == len(groups)
    pairs = {(p.subject_id_a, p.subject_id_b) for p in person_pairs(splits).collect()}
    assert pairs == {(a, b) for g in groups for a in g for b in g if a < b}


def test_proportions(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for s in range(1000, 1300):
        for i in range(rng.randrange(1, 12)):
            rows.append(((k := k + 1), str(s), float(i), rng.choice([60.0, 120.0, 130.0])))
    rows += [(k + 1 + i, "5000", float(i), 120.0) for i in range(len(rows) // 2)]  # a third of all rows
    splits = person_splits(canonical(spark, rows), spark.createDataFrame([], SUBJECTS))
    share = {r.split: r.n / len(rows) for r in splits.groupBy("split").agg(F.sum("n_rows").alias("n")).collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.01) and share["validation"] == pytest.approx(0.1, abs=0.01) and share["test"] == pytest.approx(0.1, abs=0.01)


def test_empty(spark):
    assert person_splits(canonical(spark, []), spark.createDataFrame([], SUBJECTS)).count() == 0


def test_anneal_never_gets_worse():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 200).astype(float)
    positive = np.floor(size * rng.random(200))
    start = rng.integers(0, 3, 200)
    want = np.array([v.sum() * np.array([0.8, 0.1, 0.1]) for v in (size, positive)])
    scale = np.array([size.sum(), positive.sum()])
    energy = lambda at: sum(((np.bincount(at, weights=v, minlength=3) - want[d]) ** 2).sum() / scale[d] ** 2 for d, v in enumerate((size, positive)))
    best, reported = anneal(size, positive, start, want, scale, 1, 20_000)
    assert energy(best) == pytest.approx(reported, abs=1e-9) and energy(best) < 1e-3 < energy(start)
