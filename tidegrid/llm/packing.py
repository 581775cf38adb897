"""Filling containers of fixed capacity: first-fit decreasing in randomised groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a container.
CAPACITY = 4096
#: Items of a group on average. A group leaves at most a few containers half empty, so larger groups waste less.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of every item (sizes from 1 to capacity), by first fit over falling sizes.

    A tournament tree holds in every node the most room of the containers below it, so the first
    container with enough room is found by one descent.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    container = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        container[i] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return container


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 5) -> DataFrame:
    """Packs items (doc_id bigint, n_tokens bigint) into containers.

    Columns: doc_id, piece (from 0), n_pieces, start_token, n_tokens and container_id. Only an item larger than
    the capacity is cut, into pieces of the capacity and a rest. An item without tokens needs no
    container: one piece of 0 tokens, container_id NULL. Items with the same doc_id are
    packed separately. Container ids are unique over all groups.
    """
    groups = max(1, -(-sizes.count() // group_items))
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("bigint")
    pieces = (
        sizes.select("doc_id", n.alias("whole"), count.alias("n_pieces"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)).alias("piece"))
        .select("doc_id", "piece", "n_pieces", (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("piece") * capacity).alias("n_tokens"))
        .withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(groups)).cast("int"))
    )

    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "piece"], ignore_index=True)
        size = items.n_tokens.to_numpy()
        container = first_fit_decreasing(np.maximum(size, 0), capacity) + (int(key[0]) << 32)
        items["container_id"] = pd.array(container, "Int64")
        items.loc[size == 0, "container_id"] = pd.NA
        return items.drop(columns="bin_group")

    return pieces.groupBy("bin_group").applyInPandas(fill, "doc_id bigint, piece bigint, n_pieces bigint, start_token bigint, n_tokens bigint, container_id bigint")
