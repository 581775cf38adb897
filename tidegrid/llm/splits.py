"""Train, validation and test splits that keep the records of one person together.

Ids are tied into components (spellings, person references, earlier ids). Component swap search then
starts from a hashed assignment and anneals: blocks of components are searched in parallel, several chains
each, moving or exchanging whole components to bring sizes and label shares to the
wanted proportions; the best chain of each block is kept, and later rounds spread what is
left of the overall deviation over new blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import connected_components
from tidegrid.session import checkpointed, value_or_null

SPLITS = ("train", "validation", "test")
PROPORTIONS = (0.8, 0.1, 0.1)
BLOCK = 2048


def plain_id(column: str | Column) -> Column:
    """Letters (upper case) and number (without leading zeros and '.0') of an id or reference, whatever
    signs stand between; NULL for a place-holder, that is, without a number above zero."""
    column = F.col(column) if isinstance(column, str) else column
    ascii_digits = F.translate(column, "０１２３４５６７８９", "0123456789")
    bare = F.upper(F.regexp_replace(ascii_digits, r"[^\p{L}\p{N}.]", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.0*$", ""), r"\.", "")
    parts = F.regexp_replace(bare, r"^(\p{L}*)0+(?=[0-9])", "$1")
    return F.when(parts.rlike(r"^\p{L}*[1-9][0-9]*$"), parts)


def person_edges(ids: DataFrame, subjects: DataFrame) -> DataFrame:
    """Edges (a, b) that tie written ids ('w:'), plain ids ('s:') and person references ('p:') together."""
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    plain = plain_id("subject_id")
    written = ids.select(tagged("w:", F.col("subject_id")).alias("a"), F.coalesce(tagged("s:", plain), tagged("w:", F.col("subject_id"))).alias("b"))
    known = subjects.where(plain.isNotNull())
    references = known.select(tagged("s:", plain).alias("a"), tagged("p:", plain_id("person_ref")).alias("b"))
    earlier = known.select(tagged("s:", plain).alias("a"), tagged("s:", plain_id("prior_subject_id")).alias("b"))
    return written.union(references).union(earlier).where(F.col("b").isNotNull())


def anneal(size: np.ndarray, positive: np.ndarray, start: np.ndarray, want: np.ndarray, scale: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """Best assignment found from start and its energy: the sum over splits of the squared deviations of
    size and label, each over its scale. want: (2, 3) wanted sums."""
    rng = np.random.default_rng(seed)
    n = len(size)
    at = start.astype(int).tolist()
    s, p = (size / scale[0]).tolist(), (positive / scale[1]).tolist()
    gap = [[float(np.bincount(start, weights=v, minlength=3)[k] / scale[d] - want[d][k] / scale[d]) for k in range(3)] for d, v in enumerate((size, positive))]
    energy = sum(x * x for row in gap for x in row)
    best, best_at = energy, list(at)
    one, other, target, luck = rng.integers(0, n, steps).tolist(), rng.integers(0, n, steps).tolist(), rng.integers(1, 3, steps).tolist(), rng.random(steps).tolist()
    hot = max(energy, 1e-9) * 0.3
    g0, g1 = gap
    for k in range(steps):
        i, a = one[k], at[one[k]]
        if k % 2:
            j, b = other[k], at[other[k]]
            ds, dp = s[i] - s[j], p[i] - p[j]
        else:
            j, b = -1, (a + target[k]) % 3
            ds, dp = s[i], p[i]
        if a == b:
            continue
        change = 2 * ds * (g0[b] - g0[a] + ds) + 2 * dp * (g1[b] - g1[a] + dp)
        if change <= 0 or luck[k] < math.exp(-change / (hot * (1 - k / steps) ** 3 + 1e-12)):
            g0[a] -= ds
            g0[b] += ds
            g1[a] -= dp
            g1[b] += dp
            at[i] = b
            if j >= 0:
                at[j] = a
            energy += change
            if energy < best - 1e-15:
                best, best_at = energy, list(at)
    return np.array(best_at), best


def swap_search(components: DataFrame, proportions=PROPORTIONS, rounds: int = 3, chains: int = 4, steps: int = 20_000, seed: int = 11) -> DataFrame:
    """(component, split number) for components (component, n_rows, n_positive)."""
    total = components.agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows"), F.sum("n_positive").alias("positive")).first()
    if not total["n"]:
        return components.select("component", F.lit(0).alias("split"))
    share = F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    start = F.when(share < proportions[0], 0).when(share < proportions[0] + proportions[1], 1).otherwise(2)
    state = checkpointed(components.withColumn("split", start))
    blocks = max(1, -(-total["n"] // BLOCK))
    for round_ in range(rounds):
        sums = {r["split"]: r for r in state.groupBy("split").agg(F.sum("n_rows").alias("rows"), F.sum("n_positive").alias("positive")).collect()}
        excess = np.array([[(sums[k][c] if k in sums else 0) - proportions[k] * (total[c] or 0) for k in range(3)] for c in ("rows", "positive")], float)

        def search(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
            # the wanted sums of a block: what it holds now, less its share of the overall excess
            block = block.sort_values("component", ignore_index=True)
            size, positive, split = block.n_rows.to_numpy(float), block.n_positive.to_numpy(float), block.split.to_numpy()
            now = np.array([np.bincount(split, weights=v, minlength=3) for v in (size, positive)])
            best, energy = anneal(size, positive, split, now - excess / blocks, np.maximum(now.sum(1), 1.0), int(key[1]) + 1000 * round_ + seed, steps)
            return pd.DataFrame({"block": key[0], "chain": key[1], "energy": energy, "component": block.component, "n_rows": block.n_rows, "n_positive": block.n_positive, "split": best.astype("int32")})

        block = F.pmod(F.xxhash64("component", F.lit(seed + round_ + 1)), F.lit(blocks)).cast("int")
        tried = state.withColumn("block", block).withColumn("chain", F.explode(F.array(*(F.lit(i) for i in range(chains))))).groupBy("block", "chain").applyInPandas(search, "block int, chain int, energy double, component string, n_rows bigint, n_positive bigint, split int")
        tried = checkpointed(tried)
        winner = tried.groupBy("block").agg(F.min_by("chain", F.struct("energy", "chain")).alias("chain"))
        state = checkpointed(tried.join(winner, ["block", "chain"], "left_semi").select("component", "n_rows", "n_positive", "split"))
    return state


def person_splits(records: DataFrame, subjects: DataFrame, proportions=PROPORTIONS, **search) -> DataFrame:
    """Split of every written subject_id: (subject_id, component, n_ids, n_rows, split), n_ids being the number of ids of the person.

    All ids of one person get the same split; proportions are of rows, and the share of low glucose
    readings (usable and under 70) is balanced as the label. Rows without subject_id have no split. Ids
    that name nobody by rule stand for themselves, exactly as written. A component
    larger than a split's share can only be balanced by the others.
    """
    glucose = value_or_null("glucose")
    ids = checkpointed(
        records.where(F.col("subject_id").isNotNull())
        .groupBy("subject_id")
        .agg(F.count("*").alias("n_rows"), F.count(F.when(glucose.between(20, 70) & (glucose < 70), 1)).alias("n_positive"))
    )
    member = connected_components(person_edges(ids, subjects)).where(F.col("node").startswith("w:")).select(F.expr("substring(node, 3)").alias("subject_id"), "component")
    tied = checkpointed(ids.join(member, "subject_id"))
    sizes = tied.groupBy("component").agg(F.count("*").alias("n_ids"), F.sum("n_rows").alias("n_rows"), F.sum("n_positive").alias("n_positive"))
    split = swap_search(sizes.drop("n_ids"), proportions, **search).select("component", "split").join(sizes.select("component", "n_ids"), "component")
    names = F.array(*(F.lit(x) for x in SPLITS))
    return tied.join(split, "component").select("subject_id", "component", "n_ids", "n_rows", F.element_at(names, F.col("split") + 1).alias("split"))


def person_pairs(splits: DataFrame) -> DataFrame:
    """Pairs of different written ids of one person, the lesser first by code points. Of a person with one id there are none."""
    splits = splits.where(F.col("n_ids") > 1)
    a = splits.select("component", "split", F.col("subject_id").alias("subject_id_a"))
    b = splits.select("component", "split", F.col("subject_id").alias("subject_id_b"))
    return a.join(b, ["component", "split"]).where(F.col("subject_id_a") < F.col("subject_id_b")).select("subject_id_a", "subject_id_b")
