"""Pairing records with the nearest record in time of the same entity.

Both sides are repartitioned by entity and time block (so that a hot entity is spread) and sorted;
right records near a block's border are also sent to the block beyond it. A streaming merge then
walks each partition once, holding only the last right record and the left records
that still wait for the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_US = 86_400_000_000

OUTPUT = "left_id bigint, right_id bigint, distance_us bigint"


def merge(batches: Iterator[pa.RecordBatch], tolerance_us: int) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (entity, block, us, side, id) in that order; side 0 is right, 1 is left.

    Of two equally near right records the earlier is taken, of equal times the lower id."""
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    held = None

    def settle(rows: pa.Table, final: bool):
        entity = rows.column("entity").combine_chunks().dictionary_encode().indices.to_numpy()
        block, us, side, ident = (rows.column(c).to_numpy() for c in ("block", "us", "side", "id"))
        size = len(us)
        new = np.r_[True, (entity[1:] != entity[:-1]) | (block[1:] != block[:-1])]
        key = np.cumsum(new)
        right = np.flatnonzero(side == 0)
        again = np.r_[False, (key[right][1:] == key[right][:-1]) & (us[right][1:] == us[right][:-1])] if len(right) else np.zeros(0, bool)
        right = right[~again]
        place = np.searchsorted(right, np.arange(size), "right")  # right records up to each row
        left = np.flatnonzero(side == 1)
        if len(right):
            b, a = place[left] - 1, place[left]
            before, after = right[np.maximum(b, 0)], right[np.minimum(a, len(right) - 1)]
            has_before = (b >= 0) & (key[before] == key[left])
            has_after = (a < len(right)) & (key[after] == key[left])
        else:
            before = after = np.zeros(len(left), int)
            has_before = has_after = np.zeros(len(left), bool)
        done = has_after | (key[left] < key[-1]) | (us[-1] - us[left] > tolerance_us) | final
        back = np.where(has_before, us[left] - us[before], np.iinfo(np.int64).max)
        ahead = np.where(has_after, us[after] - us[left], np.iinfo(np.int64).max)
        take, gap = np.where(back <= ahead, before, after), np.minimum(back, ahead)
        hit = done & (gap <= tolerance_us)
        found = pa.RecordBatch.from_arrays([pa.array(ident[left[hit]]), pa.array(ident[take[hit]]), pa.array(gap[hit])], names=names)
        keep = left[~done]
        if len(right) and key[right[-1]] == key[-1]:
            keep = np.r_[right[-1], keep]
        return found, rows.take(pa.array(np.sort(keep))), key[-1] == 1

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None and held.num_rows:
            rows = pa.concat_tables([held, rows])
        found, held, _ = settle(rows, final=False)
        if found.num_rows:
            yield found
    if held is not None and held.num_rows:
        yield settle(held, final=True)[0]


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int, block_us: int = BLOCK_US) -> DataFrame:
    """Nearest right record of every left record: (left_id, right_id, distance_us).

    left and right: (entity, us bigint, id bigint). Left records without a right record of their entity
    within tolerance_us (inclusive) have no row; rows with a NULL entity or time never match. A left
    record that occurs twice is matched twice. tolerance_us must not exceed block_us.
    """
    if not 0 <= tolerance_us <= block_us:
        raise ValueError("tolerance_us must be between 0 and block_us")
    known = F.col("entity").isNotNull() & F.col("us").isNotNull()
    home = F.floor(F.col("us") / F.lit(block_us)).cast("bigint")
    inside = F.pmod(F.col("us"), F.lit(block_us))
    blocks = F.filter(
        F.array(home, F.when(inside <= tolerance_us, home - 1), F.when(inside >= block_us - tolerance_us, home + 1)), lambda b: b.isNotNull()
    )
    to_right = right.where(known).select("entity", F.explode(blocks).alias("block"), "us", F.lit(0).alias("side"), "id")
    to_left = left.where(known).select("entity", home.alias("block"), "us", F.lit(1).alias("side"), "id")
    rows = to_right.unionByName(to_left).repartition("entity", "block").sortWithinPartitions("entity", "block", "us", "side", "id")
    return rows.mapInArrow(lambda it: merge(it, tolerance_us), OUTPUT)
