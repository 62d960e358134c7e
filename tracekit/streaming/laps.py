"""Laps of an event stream: state carried per session, and summaries as laps close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lap_summary(stream: DataFrame, session: str, ts: str, lap: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(session, start, n, first, last) of each lap, a window of event time, once no more rows are awaited for it. State: one row per open lap."""
    return stream.withWatermark(ts, late).groupBy(session, F.window(ts, lap)).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(session, F.col("window.start").alias("start"), "n", "first", "last")


def carried(stream: DataFrame, session: str, order: str, t: str, value: str) -> DataFrame:
    """(session, order, t, value): null values take the last one before; records whose time is under that of a kept one are left out.

    ``order`` orders the records of a session within a trigger; the state, a time and a value per session, carries on between triggers.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")  # a trigger's rows of one session: bound a trigger by maxFilesPerTrigger or maxBytesPerTrigger
        high = rows[t].cummax() if last is None else rows[t].cummax().clip(lower=last)
        rows = rows[rows[t] >= high].copy()
        if len(rows):
            rows[value] = rows[value].ffill() if held is None else rows[value].ffill().fillna(held)
            end = rows[value].iloc[-1]
            state.update((int(rows[t].iloc[-1]), None if pd.isna(end) else float(end)))
        yield rows[[session, order, t, value]]

    cols = stream.select(F.col(session).cast("long"), F.col(order).cast("long"), F.col(t).cast("long"), F.col(value).cast("double"))
    return cols.groupBy(session).applyInPandasWithState(step, f"`{session}` long, `{order}` long, `{t}` long, `{value}` double", "t long, v double", "append", GroupStateTimeout.NoTimeout)
