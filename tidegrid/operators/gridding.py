"""Irregular readings onto a regular grid: a continuous-time local-trend Kalman smoother.

The signal of one source is an integrated Wiener process (level and slope, spectral density q)
seen through noise of variance r. Readings are first averaged per slot, so a source never has
more rows than its calendar has slots, however densely it reports. One shuffle by source then
serves the fit of r and q and the smoother, both vectorised: hundreds of segments advance
in lock-step. Grid values inside a stretch between two readings follow in closed
form from the two smoothed end states, so the grid itself is exploded in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.batching import column, group_quantile, whole_groups
from tidegrid.session import micros, value_or_null

SLOT_US = 300_000_000
#: Readings of a segment advanced in lock-step, and the readings before and after it that warm it
#: up: the influence of where a segment starts fades with a scale of (r/q)^(1/4) slots, under 24 for the ratios tried.
CORE, HALO = 384, 96
#: Ratios q/r that are tried for a source. Before its readings are seen, the logarithm (base 10) of the ratio is expected about LIKELY, give or
#: take a factor of ten, and r about USUAL, with the weight of one reading: no bound on r or q, but short sources stay near.
RATIOS = 10.0 ** np.arange(-5.5, 3.01, 0.5)
LIKELY, USUAL = -1.0, 9.0
#: First readings of a segment, from which nothing is learnt.
WARM = 8
#: Shares of the squared normal below 1.645 squared and 2 squared, about: the likelihood takes its scale from the former, so that spikes don't
#: decide, and r is such that two standard deviations hold the latter of the next readings.
BULK, HELD = (0.90, 2.706), (0.96, 4.0)

NODE_FIELDS = (
    "subject_id string, slot bigint, next_slot bigint, first boolean, n_readings bigint, next_readings bigint, "
    "t double, h double, level double, slope double, next_level double, next_slope double, r double, q double, "
    "p00 double, p01 double, p11 double, n00 double, n01 double, n11 double, c00 double, c01 double, c10 double, c11 double"
)


def slot_readings(df: DataFrame, low: float = 20.0, high: float = 600.0, slot_us: int = SLOT_US) -> DataFrame:
    """Usable readings (neither NULL nor NaN, within [low, high]) averaged per source and slot.

    Rows without source or time are left out. Repeated readings weigh by their number.
    """
    us = micros("timestamp")
    usable = df.select("subject_id", us.alias("us"), value_or_null("glucose").alias("y")).where(
        F.col("subject_id").isNotNull() & F.col("us").isNotNull() & F.col("y").between(low, high)
    )
    slot = F.floor(F.col("us") / F.lit(slot_us)).cast("bigint")
    return (
        usable.withColumn("slot", slot)
        .groupBy("subject_id", "slot")
        .agg(
            F.avg((F.col("us") - F.col("slot") * F.lit(slot_us)) / F.lit(float(slot_us))).alias("offset"),
            F.avg("y").alias("y"),
            F.count("*").alias("n"),
        )
        .select("subject_id", "slot", (F.col("slot") + F.col("offset")).alias("t"), "y", "n")
    )


def surprises(t, y, r, ratio, valid):
    """Squared innovation over its variance, and that variance, of every step of many segments filtered in lock-step, for noise r and
    trend density `ratio`; all arguments but ratio are (segments, steps) arrays."""
    count, steps = t.shape
    squared, variance = np.full((steps, count), np.nan), np.ones((steps, count))
    dts = np.diff(t, axis=1).T
    l, s = y[:, 0].copy(), np.zeros(count)
    a, b, c = r[:, 0].copy(), np.zeros(count), np.full(count, 400.0)
    for k in range(1, steps):
        dt = dts[k - 1]
        l, a, b, c = l + s * dt, a + dt * (2 * b + dt * (c + ratio * dt / 3)), b + dt * (c + ratio * dt / 2), c + ratio * dt
        gain = a + r[:, k]
        err, on = y[:, k] - l, valid[:, k]
        squared[k], variance[k] = np.where(on, err * err / gain, np.nan), gain
        l, s = np.where(on, l + a / gain * err, l), np.where(on, s + b / gain * err, s)
        c = np.where(on, c - b * b / gain, c)
        b, a = np.where(on, b * (r[:, k] / gain), b), np.where(on, a * (r[:, k] / gain), a)
    return squared.T, variance.T


def fitted_noise(run: np.ndarray, t: np.ndarray, y: np.ndarray, n: np.ndarray, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Noise variance r of one reading, trend density q, and whether q/r is the least or greatest ratio tried, per group (numbered from 0).

    The ratio is the likeliest of RATIOS, over all readings of the source; the scale of r is that of the innovations.
    """
    groups = int(run[-1]) + 1
    a, b, _, _, _, _ = segments(run, core, 0)
    blocks = []
    for part in np.array_split(np.argsort(b - a, kind="stable"), max(1, len(a) // 384)):
        at = a[part][:, None] + np.arange(int((b - a)[part].max()))
        valid = at < b[part][:, None]
        at = np.minimum(at, b[part][:, None] - 1)
        learns = valid & (np.arange(at.shape[1]) >= WARM)
        blocks.append((at, valid, learns, t[at] - t[at[:, :1]], y[at], 1.0 / n[at], at[learns]))
    rows = np.concatenate([x[-1] for x in blocks])
    order = np.argsort(run[rows], kind="stable")
    of = run[rows][order]
    count = np.bincount(of, minlength=groups)
    best, r, which = np.full(groups, np.inf), np.full(groups, USUAL), np.zeros(groups, np.int64)
    for k, ratio in enumerate(RATIOS):
        found = [surprises(t_, y_, r_, ratio, valid) for _, valid, _, t_, y_, r_, _ in blocks]
        squared = np.concatenate([z[x[2]] for (z, _), x in zip(found, blocks)])[order]
        spread = np.bincount(of, np.log(np.concatenate([v[x[2]] for (_, v), x in zip(found, blocks)])[order]), minlength=groups)
        bulk, held = ((USUAL + count * np.nan_to_num(group_quantile(squared, of, groups, share) / normal)) / (1 + count) for share, normal in (BULK, HELD))
        cost = 0.5 * (spread + count * np.log(bulk)) + 0.5 * (np.log10(ratio) - LIKELY) ** 2
        better = cost < best
        best, r, which = np.where(better, cost, best), np.where(better, held, r), np.where(better, k, which)
    return r, r * RATIOS[which], (which == 0) | (which == len(RATIOS) - 1)


def noise(df: DataFrame, low: float = 20.0, high: float = 600.0, slot_us: int = SLOT_US) -> DataFrame:
    """Fitted r and q of every source with a usable reading, and at_bound: whether their ratio is the least or greatest tried."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in whole_groups(batches, ["subject_id"]):
            run = run - run[0]
            r, q, bound = fitted_noise(run, column(table, "t"), column(table, "y"), column(table, "n"))
            first = table.column("subject_id").combine_chunks().take(pa.array(np.flatnonzero(np.r_[True, run[1:] != run[:-1]])))
            yield pa.RecordBatch.from_arrays([first, pa.array(r), pa.array(q), pa.array(bound)], names=["subject_id", "r", "q", "at_bound"])

    return by_source(df, low, high, slot_us).mapInArrow(fitted, "subject_id string, r double, q double, at_bound boolean")


def smooth_block(t, y, r, q, valid):
    """Filter and smooth many segments in lock-step. All arguments are (segments, steps) arrays
    (q per segment); r is the variance of each reading. Returns smoothed level, slope, their
    covariance (3 arrays) and the cross-covariance with the next step (4 arrays)."""
    count, steps = t.shape
    f = [np.zeros((steps, count)) for _ in range(5)]
    p = [np.zeros((steps, count)) for _ in range(5)]
    dts = np.diff(t, axis=1).T
    l, s = y[:, 0].copy(), np.zeros(count)
    a, b, c = r[:, 0].copy(), np.zeros(count), np.full(count, 400.0)
    for k in range(steps):
        if k:
            dt = dts[k - 1]
            l, a, b, c = l + s * dt, a + dt * (2 * b + dt * (c + q * dt / 3)), b + dt * (c + q * dt / 2), c + q * dt
            for x, v in zip(p, (l, s, a, b, c)):
                x[k] = v
            gain = a + r[:, k]
            err, on = y[:, k] - l, valid[:, k]
            l, s = np.where(on, l + a / gain * err, l), np.where(on, s + b / gain * err, s)
            c = np.where(on, c - b * b / gain, c)
            b, a = np.where(on, b * (r[:, k] / gain), b), np.where(on, a * (r[:, k] / gain), a)
        for x, v in zip(f, (l, s, a, b, c)):
            x[k] = v
    out = [np.zeros((steps, count)) for _ in range(9)]
    for x, v in zip(out, (l, s, a, b, c)):
        x[-1] = v
    for k in range(steps - 2, -1, -1):
        fl, fs, fa, fb, fc = (x[k] for x in f)
        pl, ps, pa_, pb, pc = (x[k + 1] for x in p)
        dt, on = dts[k], valid[:, k + 1]
        det = pa_ * pc - pb * pb
        # G = P F' inv(P predicted)
        x00, x01, x10, x11 = fa + dt * fb, fb, fb + dt * fc, fc
        g00, g01 = (x00 * pc - x01 * pb) / det, (x01 * pa_ - x00 * pb) / det
        g10, g11 = (x10 * pc - x11 * pb) / det, (x11 * pa_ - x10 * pb) / det
        da, db, dc = a - pa_, b - pb, c - pc
        dl, ds = l - pl, s - ps
        cross = (g00 * a + g01 * b, g00 * b + g01 * c, g10 * a + g11 * b, g10 * b + g11 * c)
        u00, u01 = g00 * da + g01 * db, g00 * db + g01 * dc
        u10, u11 = g10 * da + g11 * db, g10 * db + g11 * dc
        l, s = np.where(on, fl + g00 * dl + g01 * ds, fl), np.where(on, fs + g10 * dl + g11 * ds, fs)
        a, b, c = np.where(on, fa + u00 * g00 + u01 * g01, fa), np.where(on, fb + u00 * g10 + u01 * g11, fb), np.where(on, fc + u10 * g10 + u11 * g11, fc)
        for x, v in zip(out, (l, s, a, b, c, *cross)):
            x[k] = v
    return out


def segments(run: np.ndarray, core: int, halo: int):
    """Segments of each group: first row, end row, first and end row with the warm-up added."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[starts[1:], len(run)]
    pieces = -(-(ends - starts) // core)
    of = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = starts[of] + nth * core
    b = np.minimum(a + core, ends[of])
    return a, b, np.maximum(a - halo, starts[of]), np.minimum(b + halo, ends[of]), starts, ends


def smoothed(batches: Iterator[pa.RecordBatch], core: int = CORE, halo: int = HALO) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (subject_id, slot, t, y, n) sorted by source and slot in, one node per slot with readings out."""
    names = [x.split()[0] for x in NODE_FIELDS.split(", ")]
    for table, run in whole_groups(batches, ["subject_id"]):
        slot, n = column(table, "slot", "int64"), column(table, "n", "int64")
        t, y = column(table, "t"), column(table, "y")
        run = run - run[0]
        r, q, _ = fitted_noise(run, t, y, n.astype(float))
        r, q = r[run], q[run]
        a, b, ha, hb, starts, ends = segments(run, core, halo)
        result = [np.zeros(len(t)) for _ in range(9)]
        order = np.argsort(hb - ha, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 384)):
            width = int((hb - ha)[part].max())
            at = ha[part][:, None] + np.arange(width)
            valid = at < hb[part][:, None]
            at = np.minimum(at, hb[part][:, None] - 1)
            base = t[ha[part]][:, None]
            out = smooth_block(t[at] - base, y[at], (r / n)[at], q[ha[part]], valid)
            own = (at >= a[part][:, None]) & (at < b[part][:, None]) & valid
            for x, v in zip(result, out):
                x[at[own]] = v.T[own]
        nxt = np.arange(1, len(t) + 1)
        nxt[ends - 1] = ends - 1
        first = np.zeros(len(t), bool)
        first[starts] = True
        l, s, p00, p01, p11, c00, c01, c10, c11 = result
        last = nxt == np.arange(len(t))
        c00, c01, c10, c11 = (np.where(last, x, v) for x, v in ((p00, c00), (p01, c01), (p01, c10), (p11, c11)))
        values = [table.column("subject_id").combine_chunks(), slot, slot[nxt], first, n, n[nxt], t, t[nxt] - t, l, s, l[nxt], s[nxt], r, q, p00, p01, p11, p00[nxt], p01[nxt], p11[nxt], c00, c01, c10, c11]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in values], names=names)


def by_source(df: DataFrame, low: float, high: float, slot_us: int) -> DataFrame:
    return slot_readings(df, low, high, slot_us).repartition("subject_id").sortWithinPartitions("subject_id", "slot")


def kalman_nodes(df: DataFrame, low: float = 20.0, high: float = 600.0, slot_us: int = SLOT_US, core: int = CORE, halo: int = HALO) -> DataFrame:
    """Smoothed state at every slot with readings and at the next one, per source."""
    return by_source(df, low, high, slot_us).mapInArrow(lambda it: smoothed(it, core, halo), NODE_FIELDS)


def regular_grid(df: DataFrame, max_fill_slots: int = 24, low: float = 20.0, high: float = 600.0, slot_us: int = SLOT_US, core: int = CORE, halo: int = HALO) -> DataFrame:
    """One row per source and slot from its first to its last usable reading.

    Columns: subject_id, slot_start_us, n_readings (0 where missing), missing, estimate (smoother's mean at the start of the slot; for
    the very first slot, at its first reading), sd (standard deviation of a reading at that time: the smoother's variance of the level and the noise of a reading),
    gap_slots (length of the missing run, 0 if observed) and value: the estimate, NULL in runs longer than
    max_fill_slots, which stay marked as missing. A source without usable reading has no row; a
    source with one reading has one. Repeated readings of an instant are averaged. Columns other
    than subject_id, timestamp and glucose are ignored.
    """
    nodes = kalman_nodes(df, low, high, slot_us, core, halo)
    begin = F.when(F.col("first"), F.col("slot")).otherwise(F.col("slot") + 1)
    rows = nodes.where(F.col("first") | (F.col("next_slot") > F.col("slot"))).withColumn("at", F.explode(F.sequence(begin, F.col("next_slot"))))
    h = F.col("h")
    tau = F.least(F.greatest(F.col("at") - F.col("t"), F.lit(0.0)), h)
    z = F.when(h > 0, tau / h).otherwise(F.lit(0.0))
    rows = rows.withColumn("z", z).withColumn("tau", tau)
    z = F.col("z")
    w = rows.select(
        "*",
        ((1 + 2 * z) * (1 - z) * (1 - z)).alias("w0"),
        (h * z * (1 - z) * (1 - z)).alias("w1"),
        (z * z * (3 - 2 * z)).alias("w2"),
        (h * z * z * (z - 1)).alias("w3"),
    )
    w0, w1, w2, w3 = (F.col(f"w{i}") for i in range(4))
    mean = w0 * F.col("level") + w1 * F.col("slope") + w2 * F.col("next_level") + w3 * F.col("next_slope")
    ends = (
        w0 * w0 * F.col("p00") + 2 * w0 * w1 * F.col("p01") + w1 * w1 * F.col("p11")
        + w2 * w2 * F.col("n00") + 2 * w2 * w3 * F.col("n01") + w3 * w3 * F.col("n11")
        + 2 * (w0 * w2 * F.col("c00") + w0 * w3 * F.col("c01") + w1 * w2 * F.col("c10") + w1 * w3 * F.col("c11"))
    )
    bridge = F.col("q") * F.pow(h, 3) * F.pow(z, 3) * F.pow(1 - z, 3) / 3
    observed = (F.col("at") == F.col("next_slot")) | (F.col("at") == F.col("slot"))
    gap = F.when(observed, F.lit(0)).otherwise(F.col("next_slot") - F.col("slot") - 1).cast("bigint")
    readings = F.when(F.col("at") == F.col("slot"), F.col("n_readings")).when(F.col("at") == F.col("next_slot"), F.col("next_readings")).otherwise(F.lit(0)).cast("bigint")
    graded = w.select("subject_id", (F.col("at") * F.lit(slot_us)).alias("slot_start_us"), readings.alias("n_readings"), (~observed).alias("missing"), mean.alias("estimate"), F.sqrt(F.greatest(ends + bridge, F.lit(0.0)) + F.col("r")).alias("sd"), gap.alias("gap_slots"))
    return graded.withColumn("value", F.when(F.col("gap_slots") <= max_fill_slots, F.col("estimate")))


def missing_runs(df: DataFrame, min_slots: int = 6, **options) -> DataFrame:
    """Longest runs of at least min_slots slots without reading between two slots that have one,
    read off the smoother's nodes (the ends of every interpolated stretch)."""
    slot_us = options.get("slot_us", SLOT_US)
    nodes = kalman_nodes(df, **options)
    return nodes.where(F.col("next_slot") - F.col("slot") - 1 >= min_slots).select(
        "subject_id",
        ((F.col("slot") + 1) * F.lit(slot_us)).alias("gap_start_us"),
        ((F.col("next_slot") - 1) * F.lit(slot_us)).alias("gap_end_us"),
    )
