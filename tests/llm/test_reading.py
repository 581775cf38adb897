import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import reading as R

SIMPLE = "cat dog sun hat red big run sit see mum dad bed car bus fish milk".split()
MIDDLE = "teacher garden window kitchen weather library station letter patient market".split()
HARD = "institutionalisation pharmacokinetics heterogeneity epistemology jurisprudence electrochemistry autocorrelation phosphorylation".split()


def text(rng, words, n, sentence, small):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append("The " + " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(small) for _ in range(sentence)) + ".")
    lines = [" ".join(out[i : i + 6]) for i in range(0, len(out), 6)]
    return "Home\nLog in\n" + "\n".join(lines) + "\nBack to top"


SMALL = "the and of to is was that it with by".split()


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    kinds = {1: (SIMPLE, 7), 2: (MIDDLE, 12), 3: (HARD, 18)}
    samples = [(i, 1 + i % 3, text(rng, *[kinds[1 + i % 3][0]], 80, kinds[1 + i % 3][1], SMALL)) for i in range(30)]
    docs = [(i, text(rng, kinds[1 + i % 3][0], 150, kinds[1 + i % 3][1], SMALL)) for i in range(60)]
    return samples, docs


def frames(spark, world):
    samples, docs = world
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(samples, "sample_id bigint, band bigint, sample_text string")


def test_bands(spark, world):
    d, s = frames(spark, world)
    got = {r.doc_id: r.band for r in R.reading_levels(d.withColumn("band", F.lit("x")).withColumn("rank", F.lit("x")), s.withColumn("doc_id", F.lit(1))).collect()}
    assert sum(got[i] == 1 + i % 3 for i in range(60)) >= 58


def brute_rank(words, counts, share):
    need = math.ceil(share * len(words))
    for least in sorted(set(counts.values()), reverse=True):
        vocabulary = {w for w, n in counts.items() if n >= least}
        if sum(w in vocabulary for w in words) >= need:
            return len(vocabulary)


@pytest.mark.parametrize("table_words", [65_536, 12])
def test_ranks_are_exact_whatever_the_table(spark, world, table_words):
    d, s = frames(spark, world)
    words = {i: R.split_words(R.prose(t)) for i, t in world[1]}
    counts = Counter(w for ws in words.values() for w in ws)
    got = {r.doc_id: [r[c] for c in R.RANKS] for r in R.reading_levels(d, s, table_words=table_words).collect()}
    assert got == {i: [brute_rank(ws, counts, share) for share in R.SHARES] for i, ws in words.items()}


def test_one_id_with_two_texts(spark, world):
    d, s = frames(spark, world)
    twice = d.select(F.when(F.col("doc_id") >= 6, F.col("doc_id") % 2).cast("bigint").alias("doc_id"), "text")  # NULL below 6
    bands = lambda frame, n: sorted([r[c] for c in ("band", *R.RANKS)] for r in R.reading_levels(frame, s, table_words=n).collect())
    assert bands(twice, 12) == bands(d, 65_536)


def test_the_vocabulary_decides(spark, monkeypatch):
    """Without the covering ranks many bands change."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs, samples = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/graded_samples.parquet")
    whole = {r.doc_id: r.band for r in R.reading_levels(docs, samples).collect()}
    monkeypatch.setattr(R, "MEASURES", tuple(m for m in R.MEASURES if m not in R.COVERAGE))
    without = {r.doc_id: r.band for r in R.reading_levels(docs, samples).collect()}
    changed = sum(without[k] != b for k, b in whole.items() if b)
    assert changed >= 0.05 * sum(b is not None for b in whole.values())


def test_language_is_told_by_letters():
    rng = random.Random(1)
    texts = [R.split_words(R.prose(text(rng, MIDDLE, 80, 12, SMALL))) for _ in range(12)]
    letters = R.Letters.learnt(texts)
    english, german = (letters.of(R.split_words(t)) for t in ("the teacher was in the garden with that letter", "der große Garten ist schön und für uns müde"))
    assert english > german + 1 and letters.of([]) == -math.inf


def least_score(words):
    """The threshold of samples in order of their hashes."""
    others = [R.Letters.learnt([w for i, w in enumerate(words) if i % R.FOLDS != k]) for k in range(R.FOLDS)]
    worst = min(others[i % R.FOLDS].of(w) for i, w in enumerate(words))
    back = [others[i % R.FOLDS].of([x[::-1] for x in w]) for i, w in enumerate(words)]
    return worst - R.FAR * max(0.0, worst - sum(back) / len(back))


def test_all_samples_teach_letters(spark):
    """Every one of many samples counts, and the least likely one, whichever it is, sets the threshold."""
    texts = [f"The {SIMPLE[i % 16]} sat by the {MIDDLE[i // 16 % 10]} and {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}q ran." for i in range(6_000)]
    texts[::1_500] = [f"Zyx{k} wvut qxzj kqvw xjzq vkqx jzxw." for k in range(4)]
    texts[7::100] = ["Home"] * 60
    s = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "sample_id bigint, band bigint, sample_text string")
    got = R.language(s.repartition(7))
    in_order = [r.sample_text for r in s.select(F.xxhash64("sample_text").alias("hash"), "sample_text").coalesce(1).sortWithinPartitions("hash").collect()]
    words = [w for w in (R.split_words(R.prose(t)) for t in in_order) if w]
    letters = R.Letters.learnt(words)
    assert len(words) == 5_940 and got[:2] == (letters.three, letters.two)
    assert got[2] == pytest.approx(least_score(words), abs=1e-9)
    assert R.language(s.repartition(3)) == got


def test_places_are_those_of_the_whole_order(spark, world):
    """The threshold is the same however the samples are cut into partitions and batches."""
    _, s = frames(spark, world)
    order = [r.sample_text for r in s.orderBy(F.xxhash64("sample_text")).collect()]
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1"), ("spark.sql.adaptive.enabled", "false")):
        before = spark.conf.get(key)
        spark.conf.set(key, value)
        try:
            assert R.language(s.repartition(5))[2] == pytest.approx(least_score([R.split_words(R.prose(t)) for t in order]), abs=1e-9)
        finally:
            spark.conf.set(key, before)


def test_samples_without_words(spark):
    schema = "sample_id bigint, band bigint, sample_text string"
    none = R.language(spark.createDataFrame([(1, 1, None), (2, 1, ""), (3, 2, "Home\nShop")], schema))
    assert none == ({}, {}, math.inf)
    one = "The cat sat by the red bus."
    three, _, least = R.language(spark.createDataFrame([(1, 1, one), (2, 1, None)], schema))
    assert three["the"] == 1 and least <= R.Letters.learnt([R.split_words(one)]).of(R.split_words(one))


def test_what_is_no_case(spark, world):
    d, s = frames(spark, world)
    german = "Der Garten ist schön und die Küche ist groß, weil das Haus im Norden mit dem Bild und der Straße nicht für uns ist. " * 8
    odd = [(100, ""), (101, None), (102, "Home\nShop (3)\nBlog\n" * 60), (103, "The cat sat and the dog ran to the sun."), (104, german), (105, "x" * 200_000), (106, "The cat sat. " * 40_000)]
    more = d.unionByName(spark.createDataFrame(odd, d.schema)).unionByName(d.limit(1))
    rows = R.reading_levels(more, s).collect()
    got = {r.doc_id: r.band for r in rows}
    assert [got[i] for i in range(100, 106)] == [None] * 6 and got[106] is not None
    assert len(rows) == 60 + 7 + 1


def test_empty(spark, world):
    d, s = frames(spark, world)
    assert R.reading_levels(d.limit(0), s).count() == 0
    assert {r.band for r in R.reading_levels(d, s.limit(0)).collect()} == {None}


@pytest.mark.parametrize("scale,least", [("0.001", 0.85), ("0.01", 0.95)])  # ranks of a hundred documents' words say less
def test_held_out_samples(spark, scale, least):
    folder = f"/root/testdata/sf{scale}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    samples = spark.read.parquet(f"{folder}/graded_samples.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    known, held = samples.where("sample_id % 2 = 0"), samples.where("sample_id % 2 = 1")
    more = documents.unionByName(held.select((-F.col("sample_id")).alias("doc_id"), F.col("sample_text").alias("text")))
    got = {-r.doc_id: r.band for r in R.reading_levels(more, known, least_words=0).collect() if r.doc_id < 0}
    right = [got[r.sample_id] == r.band for r in held.collect()]
    assert len(right) >= 50 and sum(right) / len(right) >= least
