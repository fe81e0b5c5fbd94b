"""Groups of a known size over a stream: a group is emitted when its last item arrives, or when it times out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def group_tuple_stream(df: DataFrame, key: str, value: str, size: int, *, timeout_ms: int = 600_000) -> DataFrame:
    """key, values (array), complete (boolean). What never fills is emitted as incomplete after the timeout, so nothing hangs.

    State holds at most size - 1 values of a key.
    """
    kind = dict(df.dtypes)[value]

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "values": [held], "complete": [False]})
            return
        for b in batches:
            held += b[value].tolist()
        full = [held[i : i + size] for i in range(0, len(held) - size + 1, size)]
        held = held[len(full) * size :]
        if held:
            state.update((held,))
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        if full:
            yield pd.DataFrame({key: [k[0]] * len(full), "values": full, "complete": [True] * len(full)})

    rows = df.select(key, value)
    out = f"{key} {dict(df.dtypes)[key]}, values array<{kind}>, complete boolean"
    return rows.groupBy(key).applyInPandasWithState(update, out, f"held array<{kind}>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(df: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; windows close when the watermark passes them."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, window), by).count()
