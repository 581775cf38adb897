import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.llm.packing import first_fit_decreasing, pack
from tidegrid.llm.tokens import encoding, parts, token_counts, vocabulary


def plain_first_fit(sizes, capacity):
    room, out = [], np.zeros(len(sizes), int)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= sizes[i]
        out[i] = b
    return out


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=60, deadline=None)
def test_equals_plain_first_fit(sizes):
    assert first_fit_decreasing(np.array(sizes, int), 50).tolist() == plain_first_fit(sizes, 50).tolist()


def test_pack(spark):
    rng = np.random.default_rng(0)
    items = [(i, int(n)) for i, n in enumerate(rng.integers(0, 120, 500))] + [(1000, 250), (1001, None), (1002, 100), (1002, 100), (None, 30)]
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint").withColumn("piece", F.lit("x")).withColumn("bin_group", F.lit("x"))
    got = pack(df, capacity=100, group_items=100).collect()
    load = {}
    for r in got:
        assert (r.container_id is None) == (r.n_tokens == 0)
        if r.container_id is not None:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 100
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in items)
    whole = [(r.piece, r.start_token, r.n_tokens) for r in got if r.doc_id == 1000]
    assert sorted(whole) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(r.n_pieces == 1 for r in got if r.doc_id is not None and r.doc_id < 500 and r.n_tokens <= 100 and dict(items)[r.doc_id] <= 100)
    assert len([r for r in got if r.doc_id == 1002]) == 2 and len([r for r in got if r.doc_id is None]) == 1
    assert sum(load.values()) / (100 * len(load)) > 0.9
    assert pack(df.limit(0)).count() == 0


def test_tokens(spark):
    texts = ["", None, "one two", "<|endoftext|>", "a" * 500_000, "word " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert (n[0], n[1], n[2]) == (0, 0, 2) and n[3] > 1 and n[4] > 10_000 and 190_000 < n[5] < 210_000
    assert token_counts(df.limit(0)).count() == 0


ENCODE = None


def encode(text):
    global ENCODE
    if ENCODE is None:
        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
        ENCODE = encoding({"ranks": ranks, "pattern": public_tokenizers.PATTERN}).encode_ordinary
    return ENCODE(text)


@given(st.text(st.sampled_from("ab1 \n\t'.s\u00a0\u3000\x1c\u0300Я糖"), max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_parts_give_the_tokens_of_the_whole(text, size):
    cut = list(parts(text, size))
    assert "".join(cut) == text
    assert [t for p in cut for t in encode(p)] == encode(text)


def test_long_texts_count_as_a_whole(spark):
    text = "lorem ipsum 12.5 mg/dl,\n\n  dolor " * 60_000 + "a" * 450_000 + " end"
    assert len(list(parts(text))) > 3
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert token_counts(df).first().n_tokens == len(encode(text))
