"""Liveness of readers from a stream of heartbeats, by processing-time timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txweave.plans.readers import HEARTBEAT_S

STATUS = "reader_id string, status string, beats long"


def beat(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, threshold_s: int) -> pd.DataFrame:
    """The row of one reader: its beats of a batch, or the timeout of its state."""
    count = state.get[0] if state.exists else 0
    if state.hasTimedOut:
        state.remove()
        status = "lost"
    else:
        status = "alive" if state.exists else "found"
        count += sum(len(f) for f in frames)
        state.update((count,))
        state.setTimeoutDuration(threshold_s * 1000)
    return pd.DataFrame({"reader_id": [key[0]], "status": [status], "beats": [count]})


def liveness(beats: DataFrame, threshold_s: int = HEARTBEAT_S) -> DataFrame:
    """reader_id, status, beats: a row whenever a reader is found, goes on, or is lost.

    beats: reader_id, ts. A reader is lost when nothing came from it for the threshold; a later beat finds it again."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield beat(key, frames, state, threshold_s)

    return beats.groupBy("reader_id").applyInPandasWithState(update, STATUS, "beats long", "update", GroupStateTimeout.ProcessingTimeTimeout)
