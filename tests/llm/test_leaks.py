import random

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import leaks as L

WORDS = [a + b for a in "ba do fi gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zu".split() for b in "rent mond tick lar pel sot".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(2)
    opening = sentence(rng, 12)
    items = [(i, (opening + ". " if i < 3 else "") + sentence(rng, 50)) for i in range(20)] + [(50, "too short"), (51, ""), (52, None)]
    texts = {i: t for i, t in items}
    own = texts[5].split()
    docs = {
        1: sentence(rng, 80) + "\n" + texts[5] + "\n" + sentence(rng, 40),  # whole
        2: sentence(rng, 30) + " " + " ".join(own[:25]).upper().replace(" ", "  ") + "! " + sentence(rng, 30),  # half, other case
        3: sentence(rng, 30) + " " + " ".join(own[:8]) + " " + sentence(rng, 30),  # a short quotation
        4: sentence(rng, 30) + " " + opening + ". " + sentence(rng, 60),  # only the shared opening
        5: " ".join(own[:14]) + " " + sentence(rng, 20) + " " + " ".join(own[30:44]),  # two pieces in order
        6: " ".join(own[25:50]) + " " + sentence(rng, 5) + " " + " ".join(own[:2]),
        7: sentence(rng, 20) + " " + " ".join(w[:2] + "­" + w[2:] for w in own) + " end",  # invisible hyphens
        8: sentence(rng, 20) + " " + " ".join(w[:2] + "â\u0080\u008b" + w[2:] for w in own) + " end",  # garbled ones
        9: " ".join("oops" if i % 12 == 5 else w for i, w in enumerate(own)),  # small changes
        10: "", 11: None, 12: sentence(rng, 60_000) + " " + texts[7], 13: texts[0], 14: "x" * 300_000,
    }
    return items, docs


def test_finds_leaks_only(spark, world):
    items, docs = world
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("share", F.lit("x"))
    q = spark.createDataFrame(items, "item_id bigint, item_text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in L.leaks(d, q).collect()}
    assert set(got) == {(1, 5), (2, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5), (12, 7), (13, 0)}
    assert got[1, 5].share == 1.0 and got[2, 5].share == pytest.approx(0.5)
    for key in ((1, 5), (12, 7)):
        r = got[key]
        assert docs[key[0]][r.char_start : r.char_end] == dict(items)[key[1]]
    piece = docs[2][got[2, 5].char_start : got[2, 5].char_end]
    assert piece.lower().split() == dict(items)[5].split()[:25]


def test_blocks_of_items(spark, world):
    items, docs = world
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, item_text string")
    both = [sorted((r.doc_id, r.item_id) for r in L.leaks(d, q, block_words=n).collect()) for n in (10**6, 200)]
    assert both[0] == both[1] and len(both[0]) == 9


def test_empty(spark, world):
    items, docs = world
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert L.leaks(d.limit(0), q).count() == 0 and L.leaks(d, q.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "far too short a story"), (2, "far too long a story")], "doc_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.share) for r in L.leaks(short, q).collect()] == [(1, 50, 1.0)]


@pytest.mark.parametrize("text", ["Plain words, here.", "Café naïve ﬁne x", "soft­hyphen zero​width", "garbÃ©d â\u0080\u0094 dash Â­ x", "Привет мир", "İstanbul ẞ", "血糖値を測る x", "ภาษาไทย"])
def test_offsets_match_words(text):
    low = L.folded(text)
    words, spans = L.words_of(low), L.offsets(text, low)
    assert len(words) == len(spans) and all(0 <= a < b <= len(text) for a, b in spans)
    assert all("".join(L.words_of(L.folded(text[a:b]))) == w for w, (a, b) in zip(words, spans))


def test_repeated_documents(spark, world):
    items, docs = world
    d = spark.createDataFrame([(1, docs[1]), (1, docs[1]), (None, docs[1])], "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert sorted(str(r.doc_id) for r in L.leaks(d, q).collect()) == ["1", "1", "None"]


def found(spark, items, docs):
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, item_text string")
    return {(r.doc_id, r.item_id): r for r in L.leaks(d, q).collect()}


def test_an_item_that_begins_another(spark):
    rng = random.Random(5)
    short = sentence(rng, 30) + "."
    long = short + " " + sentence(rng, 60)
    got = found(spark, [(1, short), (2, long), (3, short)], {1: "x y " + short + " z", 2: long})
    assert set(got) == {(1, 1), (1, 3), (2, 1), (2, 3), (2, 2)} and got[1, 1].share == 1.0


def test_a_repeated_item_and_a_shared_opening(spark):
    rng = random.Random(6)
    opening = sentence(rng, 40) + ". "
    one, other = opening + sentence(rng, 40), opening + sentence(rng, 40)
    got = found(spark, [(1, one), (2, one), (3, other)], {1: opening + sentence(rng, 50), 2: one})
    assert set(got) == {(2, 1), (2, 2)}


def test_other_scripts(spark):
    rng = random.Random(7)
    russian = " ".join(rng.choice("сахар кровь уровень пациент утро вечер датчик измерение норма врач день ночь".split()) + str(i % 10) for i in range(40))
    chinese = "".join(rng.choice("血糖监测显示患者夜间水平低于正常范围医生建议调整剂量并继续观察") for _ in range(60))
    got = found(spark, [(1, russian), (2, chinese)], {1: "Начало " + russian + " конец", 2: "前言" + chinese[:40] + "完", 3: chinese[:9], 4: "plain English words"})
    assert set(got) == {(1, 1), (2, 2)} and got[2, 2].char_start == 2 and got[2, 2].char_end == 42
    only = found(spark, [(1, "!!! ... ???"), (2, " ")], {1: "!!! ... ???"})
    assert only == {}


def test_short_and_densely_changed_items(spark):
    rng = random.Random(8)
    short, dense = sentence(rng, 12), sentence(rng, 60)
    changed = lambda text, at: " ".join("oops" if at(i) else w for i, w in enumerate(text.split()))
    docs = {1: sentence(rng, 30) + " " + changed(short, lambda i: i == 6) + " end", 2: changed(dense, lambda i: i % 6 == 5), 3: changed(dense, lambda i: i % 2)}
    assert set(found(spark, [(1, short), (2, dense)], docs)) == {(1, 1), (2, 2)}


def test_items_that_differ_in_a_word(spark):
    """Nearly everything of either stands in the other too, and still both have leaked."""
    rng = random.Random(9)
    one = sentence(rng, 60)
    other = " ".join("changed" if i == 30 else w for i, w in enumerate(one.split()))
    assert set(found(spark, [(1, one), (2, other)], {1: one})) == {(1, 1), (1, 2)}


def test_one_word_over_and_over(spark):
    item = " ".join(["ha"] * 50) + " that was a very good joke indeed"
    got = found(spark, [(1, item)], {1: "So: " + item, 2: "ha " * 100_000, 3: "ha ha that was a very good joke indeed"})
    assert {(1, 1), (3, 1)} <= set(got) and got[1, 1].char_start == 4 and got[1, 1].share == 1.0


def brute(doc, item):
    """Most words of the item that the document holds in running order, by all pairs."""
    best = [0] * (len(doc) + 1)
    for w in item:
        row = [0]
        for j, x in enumerate(doc, 1):
            row.append(max(row[-1], best[j], best[j - 1] + (w == x)))
        best = row
    return best[-1]


def test_share_against_brute_force(spark):
    """Of a document made of pieces of one item and other words, the share is the longest common subsequence up to stray words."""
    rng = random.Random(10)
    items = [(k, sentence(rng, 50)) for k in range(6)]
    docs = {}
    for k, text in items:
        words = text.split()
        a, b = sorted(rng.sample(range(51), 2))
        docs[k] = " ".join(["zz"] * 20 + words[a:b] + ["yy"] * 15)
    got = found(spark, items, docs)
    for k, text in items:
        share = brute(docs[k].split(), text.split()) / 50
        if share >= 1 / 3:
            assert abs(got[k, k].share - share) < 0.02
        else:
            assert (k, k) not in got


def test_what_is_said_over_and_over(spark):
    item = "tick tock " * 200 + "went the clock upon the wall of our old house"
    docs = {1: "so " + item, 2: "tick tock " * 150_000, 3: "one two three " * 100_000 + item}
    got = found(spark, [(1, item), (None, item), (3, "one two three " * 50)], docs)
    assert {(1, 1), (1, None), (3, 1), (3, None), (3, 3)} <= set(got) and got[1, 1].share > 0.9


def test_items_without_a_case(spark):
    assert found(spark, [(1, None), (2, ""), (None, None)], {1: "some text of a page", None: None}) == {}
    assert L.few([])[0] == [] and L.few([5])[0] == [5] and L.few([0] * 50)[1] is None
