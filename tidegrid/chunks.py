"""Splitting of hot keys into time chunks that overlap by a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import checkpointed

#: Cells of a hot key, a power of two: about equally many rows each. Chunks are made of whole cells or, for keys with more than
#: CELLS / CHUNK_CELLS chunks, of parts of cells, of equal width.
CELLS = 1024
#: Cells of a chunk, at least, and its share of which a margin is made: at most 2/16 of a hot key's rows are repeated.
CHUNK_CELLS = 16
#: Hot keys up to which their borders (about 8 KB each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1024


def hot_keys(df: DataFrame, key: str, order: str, target_rows: int) -> DataFrame | None:
    """Keys with more than target_rows rows: (key, borders, parts, per_chunk), or None if there are none.

    borders are approximate quantiles of the order column from its least to its largest value; parts is into how many each cell
    is divided and per_chunk how many of those make a chunk of about target_rows rows.
    """
    counts = checkpointed(df.groupBy(key).agg(F.count("*").alias("count")).where(F.col("count") > target_rows))
    found = counts.count()
    if not found:
        return None
    small = found <= BROADCAST_KEYS
    wanted = counts.select(key)
    fractions = F.expr(f"array({', '.join(f'{i / CELLS!r}D' for i in range(CELLS + 1))})")
    borders = df.join(F.broadcast(wanted) if small else wanted, key, "left_semi").groupBy(key).agg(F.percentile_approx(order, fractions, F.lit(4 * CELLS)).alias("borders"), F.count("*").alias("count"))
    chunks = F.ceil(F.col("count") / F.lit(target_rows))
    parts = F.ceil(chunks * F.lit(CHUNK_CELLS) / F.lit(CELLS)).cast("int")
    hot = borders.select(key, "borders", parts.alias("parts"), F.ceil(parts * F.lit(CELLS) / chunks).cast("int").alias("per_chunk"))
    return F.broadcast(hot) if small else hot


def cell_of(order: str) -> tuple[Column, Column]:
    """Cell in which a value lies, and number of its part of that cell (given _cell). Equal values lie in the same."""
    halves = F.array(*(F.lit(CELLS >> k) for k in range(1, CELLS.bit_length())))
    cell = F.aggregate(halves, F.lit(0), lambda n, half: n + F.when(F.get("borders", n + half) <= F.col(order), half).otherwise(0))  # by halving
    low, high = F.get("borders", F.col("_cell")), F.get("borders", F.col("_cell") + 1)
    part = F.floor((F.col(order) - low) * F.col("parts") / F.greatest(high - low, F.lit(1)))
    within = F.greatest(F.lit(0), F.least(F.col("parts") - 1, part)).cast("int")
    return cell, F.col("_cell") * F.col("parts") + within


def chunked(df: DataFrame, key: str, order: str, target_rows: int) -> DataFrame:
    """Adds chunk (0 for keys that aren't hot) and core. order is a whole number.

    Rows of a hot key in the first or last sixteenth of a chunk are repeated, with core = false, in the chunk beside it, as
    context for what looks at neighbours. Every row has exactly one row with core = true.
    """
    df = df.drop("chunk", "core")
    hot = hot_keys(df, key, order, target_rows)
    if hot is None:
        return df.select("*", F.lit(0).alias("chunk"), F.lit(True).alias("core"))
    return spread_out(df, hot, key, order)


def chunk_numbers(hot: DataFrame, key: str) -> DataFrame:
    """(key, chunk) of every chunk of the hot keys."""
    last = F.floor((F.lit(CELLS) * F.col("parts") - 1) / F.col("per_chunk")).cast("int")
    return hot.select(key, F.explode(F.sequence(F.lit(0), last)).alias("chunk"))


def spread_out(df: DataFrame, hot: DataFrame, key: str, order: str, how: str = "left") -> DataFrame:
    """As chunked, given the hot keys; with how = inner the rows of hot keys only."""
    cell, place = cell_of(order)
    is_hot = F.col("borders").isNotNull()
    rows = df.join(hot, key, how).withColumn("_cell", F.when(is_hot, cell)).withColumn("_place", F.when(is_hot, place)).drop("borders", "_cell")
    size = F.col("per_chunk")
    home = F.floor(F.col("_place") / size).cast("int")
    last = F.lit(CELLS) * F.col("parts") - 1
    at = lambda chunk, core: F.struct(chunk.alias("chunk"), F.lit(core).alias("core"))
    margin = F.ceil(size / F.lit(CHUNK_CELLS))
    before = F.when((F.col("_place") % size < margin) & (home > 0), home - 1)
    after = F.when((F.col("_place") % size >= size - margin) & (home < F.floor(last / size)), home + 1)
    places = F.when(F.col("_place").isNull(), F.array(at(F.lit(0), True))).otherwise(F.filter(F.array(at(home, True), at(before, False), at(after, False)), lambda x: x["chunk"].isNotNull()))
    return rows.select("*", F.inline(places)).drop("_place", "parts", "per_chunk")
