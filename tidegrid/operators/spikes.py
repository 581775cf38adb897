"""Implausible readings: an isolation forest per source, with physical limits.

Level, difference, season and run length of every reading are scored by the forest of its source; the score
decides what is a spike or frozen, and fixed limits what is impossible.

Rows are shuffled once, by source, hot sources in time chunks of about equally many readings
with overlapping margins. Python sees whole chunks of many sources at a time and works on all of them at once. What holds of a
whole source (unit, level, spread, season, typical step, chance of frozen runs, and the forest's training rows) comes from all its rows: a hot
source's is counted beforehand and stands at the head of each of its chunks, so chunks only serve neighbours and parallelism.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.batching import column, group_quantile, whole_groups
from tidegrid.chunks import BROADCAST_KEYS, chunk_numbers, hot_keys, spread_out
from tidegrid.functions.forest import SAMPLE, TREES, forest_scores, uniform
from tidegrid.session import broadcast_if_small, checkpointed, micros

#: Of each signal: physical limits; least typical step; and the other unit, as (bounds of the source's median
#: that tell the unit, factor and offset to the usual one).
SIGNALS = {
    "glucose": {"limits": (20.0, 600.0), "step": 1.5, "other": (3.0, 30.0, 18.016, 0.0)},
    "heart_rate": {"limits": (25.0, 250.0), "step": 1.0, "other": (0.6, 3.5, 60.0, 0.0)},
    "skin_temperature": {"limits": (15.0, 45.0), "step": 0.05, "other": (60.0, 130.0, 1 / 1.8, -32 / 1.8)},
}
RULES = np.array(["", "impossible", "spike", "frozen"], dtype=object)
#: Most readings of one spike; scale of leaps in typical steps; time within which the neighbours must lie.
SPIKE_LENGTH, LEAP, NEAR_US = 3, 5.5, 2 * 3600 * 1_000_000
#: Least length of a frozen run, expected number of such runs by chance in the source, and scale of runs in lengths beyond chance.
FROZEN, CHANCE, RUN = 6, 1e-3, 0.7
#: Scale of level and season, in spreads: they saturate early, since a source's own extremes are far out but true.
AWAY = 0.25
#: Score of the forest from which a reading is implausible, if it leaps there and back by the least leap (in typical steps) or
#: repeats its value over the least part of a run beyond chance: a reading that is only high or low at an odd hour may be true.
ODD, LEAST_LEAP, LEAST_PART = 0.51, 3.0, 0.5
#: Features of a reading: level, difference, season, run length.
FEATURES = 4

#: Training rows of a source's forest, those of the least draws; and what is counted of a hot source.
KEPT = TREES * SAMPLE
VALUES, STEPS, STARTS, ROWS, BEGIN = range(5)
TALLIES = "subject_id string, signal string, kind int, other boolean, hour int, number double, count bigint"
STATS = "subject_id string, signal string, stats binary"
DRAWN = "subject_id string, signal string, us bigint, draw double, features binary"

OUTPUT = "record_id bigint, subject_id string, signal string, value double, score double, rule string"


def filled(index: np.ndarray, backward: bool = False) -> np.ndarray:
    """Last (or next) non-negative entry up to each place; -1 or len where there is none."""
    if backward:
        flipped = np.where(index[::-1] < 0, len(index), index[::-1])
        return np.minimum.accumulate(flipped)[::-1]
    return np.maximum.accumulate(index)


def usual(signal: str, other, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in the usual unit, and which of them are impossible."""
    low, high = SIGNALS[signal]["limits"]
    _, _, factor, offset = SIGNALS[signal]["other"]
    x = np.where(other, value * factor + offset, value)
    return x, (x < low) | (x > high) | ~np.isfinite(x)


def least_run(n, starts, possible):
    """Length from which a frozen run is beyond chance, of n instants with so many possible values and runs of them."""
    p = np.clip(starts / np.maximum(possible, 1), 0.5, 0.98)
    return np.maximum(FROZEN, np.ceil(1 + np.log(CHANCE / np.maximum(n, 1)) / np.log(1 - p)))


def close_by(group: np.ndarray, us: np.ndarray) -> np.ndarray:
    """Readings whose predecessor is of the same group and near enough for a step."""
    return np.r_[False, (group[1:] == group[:-1]) & (us[1:] - us[:-1] <= NEAR_US / 2)] if len(group) else np.zeros(0, bool)


def saturating(z: np.ndarray, scale: float, power: int) -> np.ndarray:
    """From 0 to 1, a half at the scale; 1 where there is no number. Large powers part what lies below and above the scale."""
    z = np.clip(np.nan_to_num(z, nan=np.inf, posinf=1e9), 0, 1e9) / scale
    return z**power / (1 + z**power)


def steps_of(x: np.ndarray) -> np.ndarray:
    return np.r_[0.0, np.abs(np.diff(x))] if len(x) else np.zeros(0)


def described(signal: str, group: np.ndarray, us: np.ndarray, value: np.ndarray, given: dict[int, np.ndarray]) -> SimpleNamespace:
    """Features of every value (no NaN), ordered by group, time and arrival, and what the exact check needs.

    given: statistics of whole sources, by the groups that are chunks of one; those of other groups come from their rows.
    """
    rows, groups = len(value), int(group[-1]) + 1
    spec = SIGNALS[signal]
    chunks = np.array(sorted(given), np.int64)
    stats = np.stack([given[k] for k in chunks.tolist()]) if given else np.zeros((0, 7 + 24))
    new_group = np.r_[True, group[1:] != group[:-1]]
    first = new_group | np.r_[True, us[1:] != us[:-1]]  # the first row of each instant
    origin = np.cumsum(first) - 1
    o = np.flatnonzero(first)
    # unit of the source
    med = group_quantile(value[o], group[o], groups)
    a, b, _, _ = spec["other"]
    other = (med >= a) & (med <= b)
    other[chunks] = stats[:, 0] > 0
    x, impossible = usual(signal, other[group], value)
    # the sequence of possible first readings
    g = np.flatnonzero(first & ~impossible)
    gg, gx, gt = group[g], x[g], us[g]
    center = group_quantile(gx, gg, groups)
    center[chunks] = stats[:, 1]
    near, steps = close_by(gg, gt), steps_of(gx)
    typical = np.maximum(np.nan_to_num(group_quantile(steps[near], gg[near], groups), nan=0.0), spec["step"])
    spread = np.maximum(np.nan_to_num(group_quantile(np.abs(gx - center[gg]), gg, groups), nan=0.0), spec["step"])
    typical[chunks], spread[chunks] = stats[:, 2], stats[:, 3]
    leap = np.zeros(len(g))
    for k in range(1, SPIKE_LENGTH + 1):
        if len(g) < k + 2:
            break
        i = np.arange(1, len(g) - k)
        pre, post = i - 1, i + k
        enter, leave = gx[i] - gx[pre], gx[post - 1] - gx[post]
        fits = (gg[pre] == gg[post]) & (gt[i] - gt[pre] <= NEAR_US) & (gt[post] - gt[post - 1] <= NEAR_US) & (enter * leave > 0)
        size = np.where(fits, np.minimum(np.abs(enter), np.abs(leave)) - np.abs(gx[pre] - gx[post]), 0) / typical[gg[i]]
        for j in range(k):
            leap[i + j] = np.maximum(leap[i + j], size)
    # runs of the very same value, over first readings
    start = np.r_[True, (group[o][1:] != group[o][:-1]) | (value[o][1:] != value[o][:-1])]
    run = np.cumsum(start) - 1
    run_length = np.bincount(run)[run]
    same = ~start & ~impossible[o]
    least = least_run(*(np.bincount(group[o][of], minlength=groups) for of in (slice(None), start & ~impossible[o], ~impossible[o])))
    least[chunks] = stats[:, 4]
    # the nearest possible readings of modest leap on either side, as the local level
    calm = np.full(len(o), -1)
    modest = leap < LEAP
    calm[origin[g[modest]]] = np.flatnonzero(modest)
    before, after = filled(np.r_[-1, calm[:-1]]), filled(np.r_[calm[1:], -1], backward=True)
    after = np.where(after >= len(calm), -1, after)
    og = group[o]

    def beside(at: np.ndarray) -> np.ndarray:
        if not len(g):
            return np.full(len(o), np.nan)
        k = np.maximum(at, 0)
        return np.where((at >= 0) & (gg[k] == og) & (np.abs(gt[k] - us[o]) <= 12 * NEAR_US), gx[k], np.nan)

    sides = np.stack([beside(before), beside(after)])
    known = ~np.isnan(sides)
    local = np.where(known.any(0), np.where(known, sides, 0).sum(0) / np.maximum(known.sum(0), 1), center[og])[origin]
    away = np.abs(x - local) / typical[group]
    row_leap = np.zeros(len(o))
    row_leap[origin[g]] = leap
    row_leap, row_run = row_leap[origin], run_length[origin]
    alike = value == value[o][origin]
    row_leap = np.where(alike, row_leap, np.where(impossible, 0, np.where(away > 2 * LEAP, away, 0)))
    row_run = np.where(alike, row_run, 1)
    # features from 0 to 1: level, difference, season (hour of day), run length against chance
    hour = (us // 3_600_000_000) % 24
    cell = group * 24 + hour
    by_hour = np.full(groups * 24, np.nan)
    if len(g):
        order = np.argsort(cell[g], kind="stable")
        by_hour = group_quantile(gx[order], cell[g][order], groups * 24)
    by_hour.reshape(groups, 24)[chunks] = stats[:, 7:]
    season = by_hour[cell]
    season = np.where(np.isnan(season), center[group], season)
    features = np.empty((rows, FEATURES), np.float32)
    features[:, 0] = saturating(np.abs(x - center[group]) / spread[group], AWAY, 1)
    features[:, 1] = saturating(np.where(impossible, np.inf, row_leap), LEAP, 4)
    features[:, 2] = saturating(np.abs(x - season) / spread[group], AWAY, 1)
    features[:, 3] = saturating((row_run - 1) / (least[group] - 1), RUN, 3)
    train = np.zeros(rows, bool)  # a frozen stretch counts once
    train[o[start]] = True
    train &= ~impossible
    begins = np.flatnonzero(new_group)
    seeds = us[begins] + np.diff(np.r_[begins, rows])
    seeds[chunks] = stats[:, 5].astype(np.int64)
    return SimpleNamespace(features=features, train=train, seeds=seeds, impossible=impossible, leap=row_leap, run=row_run, least=least)


def judge(signal: str, group: np.ndarray, us: np.ndarray, value: np.ndarray, odd: float | None = None, given: dict[int, tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Score and rule number of every value (no NaN), ordered by group, time and arrival. given: statistics of the whole source, and times and
    features of its training rows, of groups that are chunks of one."""
    given = given or {}
    d = described(signal, group, us, value, {k: stats for k, (stats, _, _) in given.items()})
    rows = len(value)
    # a chunk is scored by the forest of its source, whose training rows join it
    d.train &= ~np.isin(group, list(given))
    owner = np.concatenate([group, *(np.full(len(times), k) for k, (_, times, _) in given.items())])
    order = np.argsort(owner, kind="stable")
    number = np.concatenate([us, *(times for _, times, _ in given.values())])[order]
    features = np.concatenate([d.features, *(f for _, _, f in given.values())])[order]
    score = np.zeros(len(owner))
    score[order] = forest_scores(features, owner[order], np.r_[d.train, np.ones(len(owner) - rows, bool)][order], seeds=d.seeds, number=number)
    score = score[:rows]
    rule = np.zeros(rows, np.int8)
    strange = score >= (ODD if odd is None else odd)
    rule[strange & (d.run >= LEAST_PART * d.least[group])] = 3
    rule[strange & (d.leap >= LEAST_LEAP)] = 2
    rule[d.impossible] = 1
    return score, rule


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over chunks of hot sources: counts from which stats_of finds the statistics of the source. What depends on the
    source's unit is counted for either."""
    for rows, run in whole_groups(batches, ["subject_id", "chunk"], 32768):
        core_rows, all_us = column(rows, "core", "bool"), column(rows, "us", "int64")
        subject = rows.column("subject_id").combine_chunks()
        for signal in SIGNALS:
            value = column(rows, signal)
            has = np.flatnonzero(~np.isnan(value))
            if not len(has):
                continue
            group, us, value, core = run[has], all_us[has], value[has], core_rows[has]
            o = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (us[1:] != us[:-1])])
            hour = (us // 3_600_000_000) % 24
            start = np.r_[True, (group[o][1:] != group[o][:-1]) | (value[o][1:] != value[o][:-1])]
            mine = o[core[o]]
            found = [(VALUES, False, mine, hour[mine], value[mine]), (ROWS, False, np.flatnonzero(core), 0, 0.0)]
            first = mine[np.r_[True, group[mine][1:] != group[mine][:-1]]] if len(mine) else mine
            found.append((BEGIN, False, first, 0, us[first].astype(float)))
            for other in (False, True):
                x, impossible = usual(signal, other, value)
                begins = o[start & ~impossible[o] & core[o]]
                found.append((STARTS, other, begins, 0, 0.0))
                g = o[~impossible[o]]
                near = close_by(group[g], us[g]) & core[g]
                found.append((STEPS, other, g[near], 0, steps_of(x[g])[near]))
            for kind, other, at, of_hour, number in found:
                if not len(at):
                    continue
                key = np.rec.fromarrays([group[at], np.broadcast_to(of_hour, len(at)), np.broadcast_to(number, len(at))])
                order = np.lexsort((key.f2, key.f1, key.f0))
                key, at = key[order], at[order]
                new = np.flatnonzero(np.r_[True, (key.f0[1:] != key.f0[:-1]) | (key.f1[1:] != key.f1[:-1]) | (key.f2[1:] != key.f2[:-1])])
                n = len(new)
                yield pa.RecordBatch.from_arrays(
                    [subject.take(pa.array(has[at[new]])), pa.array([signal] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, other)), pa.array(key.f1[new].astype(np.int32)), pa.array(key.f2[new].astype(float)), pa.array(np.diff(np.r_[new, len(at)]))], names=[f.split()[0] for f in TALLIES.split(", ")]
                )


def counted_quantile(values: np.ndarray, count: np.ndarray) -> float:
    """Nearest-rank median of values that occur count times each, as group_quantile; NaN without values."""
    if not len(values):
        return np.nan
    order = np.argsort(values, kind="stable")
    total = np.cumsum(count[order])
    return values[order][np.searchsorted(total, np.floor((total[-1] - 1) * 0.5), side="right")]


def stats_of(signal: str, kind: np.ndarray, other: np.ndarray, hour: np.ndarray, number: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Statistics of one source, from its counts: unit, centre, typical step, spread, least frozen run, seed, training rows, season by hour."""
    of = kind == VALUES
    value, hour, times = number[of], hour[of], count[of]
    a, b, _, _ = SIGNALS[signal]["other"]
    turned = a <= counted_quantile(value, times) <= b
    x, impossible = usual(signal, turned, value)
    good = ~impossible
    center = counted_quantile(x[good], times[good])
    floor = SIGNALS[signal]["step"]
    steps = (kind == STEPS) & (other == turned)
    typical = max(np.nan_to_num(counted_quantile(number[steps], count[steps])), floor)
    spread = max(np.nan_to_num(counted_quantile(np.abs(x[good] - center), times[good])), floor)
    starts = count[(kind == STARTS) & (other == turned)].sum()
    seed = number[kind == BEGIN].min() + count[kind == ROWS].sum()
    season = [counted_quantile(x[good & (hour == h)], times[good & (hour == h)]) for h in range(24)]
    return np.array([turned, center, typical, spread, least_run(times.sum(), starts, times[good].sum()), seed, starts, *season], float)


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over the summed counts, sorted by source and signal."""
    for rows, run in whole_groups(batches, ["subject_id", "signal"], 32768):
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        signals = rows.column("signal").combine_chunks().take(pa.array(begins)).to_pylist()
        columns = [column(rows, "kind", "int64"), column(rows, "other", "bool"), column(rows, "hour", "int64"), column(rows, "number"), column(rows, "count", "int64")]
        stats = [stats_of(signal, *(c[a:b] for c in columns)).tobytes() for signal, a, b in zip(signals, begins, np.r_[begins[1:], len(run)])]
        yield pa.RecordBatch.from_arrays([rows.column("subject_id").combine_chunks().take(pa.array(begins)), pa.array(signals, pa.string()), pa.array(stats, pa.binary())], names=["subject_id", "signal", "stats"])


def heads(rows: pa.Table, run: np.ndarray) -> dict[str, dict[int, tuple]]:
    """By signal and run: statistics of the whole source, and times and features of its training rows, as they stand at the head of its chunks."""
    out: dict[str, dict[int, tuple]] = {signal: {} for signal in SIGNALS}
    about = rows.column("about").combine_chunks()
    at = pa.compute.indices_nonzero(about.is_valid())
    few = rows.select(["about", "stats", "sample"]).take(at).to_pylist()
    for k, head in zip(np.asarray(at).tolist(), few):
        sample = np.frombuffer(head["sample"] or b"", np.dtype([("us", np.int64), ("features", np.float32, FEATURES)]))
        out[head["about"]][int(run[k])] = np.frombuffer(head["stats"], float), sample["us"], sample["features"]
    return out


def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over chunks of hot sources with heads: training rows of the least draws, some twice as many as are wanted."""
    for rows, run in whole_groups(batches, ["subject_id", "chunk"], 32768):
        us, core, known = column(rows, "us", "int64"), column(rows, "core", "bool"), heads(rows, run)
        subject = rows.column("subject_id").combine_chunks()
        for signal in SIGNALS:
            value = column(rows, signal)
            has = np.flatnonzero(~np.isnan(value))
            if not len(has):
                continue
            runs, group = np.unique(run[has], return_inverse=True)
            stats = {k: known[signal][r][0] for k, r in enumerate(runs.tolist())}
            d = described(signal, group, us[has], value[has], stats)
            draw = uniform(d.seeds[group], us[has])
            bound = np.array([2 * KEPT / max(1.0, stats[k][6]) for k in range(len(runs))])
            at = np.flatnonzero(d.train & core[has] & (draw < bound[group]))
            yield pa.RecordBatch.from_arrays([subject.take(pa.array(has[at])), pa.array([signal] * len(at), pa.string()), pa.array(us[has[at]]), pa.array(draw[at]), pa.array([f.tobytes() for f in d.features[at]], pa.binary())], names=[f.split()[0] for f in DRAWN.split(", ")])


def judged(batches: Iterator[pa.RecordBatch], only_flagged: bool) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over rows sorted by source, chunk, time and record_id."""
    names = [f.split()[0] for f in OUTPUT.split(", ")]
    for rows, run in whole_groups(batches, ["subject_id", "chunk"], 32768):
        us, core, known = column(rows, "us", "int64"), column(rows, "core", "bool"), heads(rows, run)
        subject = rows.column("subject_id").combine_chunks()
        record = rows.column("record_id").combine_chunks()
        for signal in SIGNALS:
            value = column(rows, signal)
            has = np.flatnonzero(~np.isnan(value))
            if not len(has):
                continue
            runs, group = np.unique(run[has], return_inverse=True)
            given = {k: known[signal][r] for k, r in enumerate(runs.tolist()) if r in known[signal]}
            score, rule = judge(signal, group, us[has], value[has], given=given)
            keep = core[has] & ((rule > 0) | (not only_flagged))
            at = pa.array(has[keep])
            rule_names = RULES[rule[keep]]
            yield pa.RecordBatch.from_arrays(
                [record.take(at), subject.take(at), pa.array([signal] * len(at), pa.string()), pa.array(value[has[keep]]), pa.array(score[keep]), pa.array(rule_names, pa.string(), mask=rule_names == "")], names=names
            )


def in_order(parts: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Rows with chunk and core, after the heads of their chunks if there are any."""
    parts = parts.select("subject_id", "chunk", "core", "us", "record_id", *SIGNALS, F.lit(None).cast("string").alias("about"), F.lit(None).cast("binary").alias("stats"), F.lit(None).cast("binary").alias("sample"))
    if heads is not None:
        empty = {c: F.lit(None).cast("double") for c in SIGNALS} | {"record_id": F.lit(None).cast("bigint")}
        parts = parts.unionByName(heads.withColumns(empty | {"core": F.lit(False), "us": F.lit(-(2**63)).cast("bigint")}))
    return parts.repartition("subject_id", "chunk").sortWithinPartitions("subject_id", "chunk", "us", F.col("about").asc_nulls_last(), "record_id")


def heads_of(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """What holds of each hot source as a whole, once for each of its chunks and signals: (subject_id, chunk, about, stats, sample).

    Two passes over the rows of hot sources: counts of values by hour and of steps, summed by source, give the statistics; with these the
    features of the training rows of the least draws. A source's counts have one row per distinct value and hour.
    """
    parts = spread_out(rows, hot, "subject_id", "us", how="inner")
    numbers = chunk_numbers(hot, "subject_id")

    def of_chunks(d: DataFrame) -> DataFrame:
        return d.withColumnRenamed("signal", "about").join(numbers, "subject_id")

    key = ["subject_id", "signal"]
    counts = in_order(parts).mapInArrow(tallied, TALLIES).groupBy(*key, "kind", "other", "hour", "number").agg(F.sum("count").alias("count"))
    stats = checkpointed(counts.repartition(*key).sortWithinPartitions(*key).mapInArrow(settled, STATS))
    draws = in_order(parts, of_chunks(stats.withColumn("sample", F.lit(None).cast("binary")))).mapInArrow(drawn, DRAWN)
    sample = draws.groupBy(*key).applyInArrow(kept, "subject_id string, signal string, sample binary")
    return of_chunks(checkpointed(stats.join(sample, key, "left")))


def kept(rows: pa.Table) -> pa.Table:
    """The KEPT training rows of the least draws of a source, packed."""
    us = column(rows, "us", "int64")
    least = np.lexsort((us, column(rows, "draw")))[:KEPT]
    features = rows.column("features").take(pa.array(least)).to_pylist()
    sample = b"".join(u.tobytes() + f for u, f in zip(us[least], features))
    return pa.table({"subject_id": rows.column("subject_id").slice(0, 1), "signal": rows.column("signal").slice(0, 1), "sample": pa.array([sample], pa.binary())})


def score_readings(df: DataFrame, only_flagged: bool = False, target_rows: int = 50_000) -> DataFrame:
    """Score and rule of every glucose, heart_rate and skin_temperature value, per source.

    Columns: record_id, subject_id, signal, value, score (isolation score, high is odd) and rule: 'impossible' (outside physical limits,
    which also holds values given in another unit than the source's others), 'spike' (leaps away for at most three readings and comes back),
    'frozen' (very same value far longer than chance) or NULL. But for the limits, the forest decides: a spike or frozen reading
    has a score of at least ODD, and then a leap of LEAST_LEAP typical steps or LEAST_PART of the length beyond chance. Rows without source or time
    and NULL or NaN values have no row. Repeated rows are judged like their first; a row of the same
    instant with another value is judged against the readings beside it.
    """
    rows = df.select("subject_id", micros("timestamp").alias("us"), "record_id", *SIGNALS).where(F.col("subject_id").isNotNull() & F.col("us").isNotNull() & F.coalesce(*SIGNALS).isNotNull())
    hot = hot_keys(rows, "subject_id", "us", target_rows)
    if hot is None:
        parts = in_order(rows.withColumns({"chunk": F.lit(0), "core": F.lit(True)}))
    else:
        hot, _ = broadcast_if_small(checkpointed(hot), BROADCAST_KEYS)
        parts = in_order(spread_out(rows, hot, "subject_id", "us"), heads_of(rows, hot))
    return parts.mapInArrow(lambda it: judged(it, only_flagged), OUTPUT)


def implausible(df: DataFrame) -> DataFrame:
    """Readings that the source's sensor cannot have measured properly."""
    return score_readings(df, only_flagged=True).select("record_id", "signal")
