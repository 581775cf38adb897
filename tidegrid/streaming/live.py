"""Structured Streaming forms of the slot synchronisation and of the simulator's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.twin import Parameters, State, update


def slots(records: DataFrame, late: str = "15 minutes") -> DataFrame:
    """Five-minute slots of a stream of records (with ts timestamp): each slot comes out once the watermark has passed it.
    First values are by (time, stream, seq), as in the batch operator."""
    order = F.struct("us", "rank", "seq")
    first = lambda v: F.min_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v)
    d = records.withWatermark("ts", late).groupBy("subject_id", F.window("ts", "5 minutes")).agg(*(first(v) for v in ("glucose", "basal_insulin", "bolus_insulin", "carbohydrates")))
    return d.select("subject_id", F.unix_micros("window.start").alias("us"), "glucose", "basal_insulin", "bolus_insulin", "carbohydrates")


STATE = "us bigint, glucose double, insulin_action double, insulin_state double, meal_state double"
OUTPUT = "subject_id string, us bigint, glucose double, insulin_action double, insulin_state double, meal_state double, flags array<string>"


def live_states(readings: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """Simulator state after every reading of a stream of slots, without burn-in or personal baseline. A reading not after
    the subject's state is dropped; a subject starts with its first glucose."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = State(*state.get) if state.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values("us")
        value = lambda v: None if pd.isna(v) else float(v)
        for r in rows.itertuples(index=False):
            glucose = value(r.glucose)
            if now is None:
                if glucose is None:
                    continue
                now = State(int(r.us), glucose)
            elif r.us <= now.us:
                continue
            else:
                now = update(now, int(r.us), glucose, value(r.carbohydrates), value(r.bolus_insulin), value(r.basal_insulin), p=parameters)
            out.append((key[0], now.us, now.glucose, now.insulin_action, now.insulin_state, now.meal_state, list(now.flags)))
        if now is not None:
            state.update((now.us, now.glucose, now.insulin_action, now.insulin_state, now.meal_state))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    return readings.groupBy("subject_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
