"""The request queue as a stream: requests get their place in their branch's queue as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (n,) = state.get if state.exists else (0,)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    yield pd.DataFrame({"branch_id": key[0], "event_id": rows["event_id"], "place": range(n, n + len(rows))})
    state.update((n + len(rows),))


def queue_places(events: DataFrame) -> DataFrame:
    """(branch_id, event_id, place) for a stream (or batches) of (event_id, ts, user_id): FIFO by time within a
    micro-batch, and behind all that came in earlier ones.  State is one number a branch."""
    rows = events.select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(_place, "branch_id long, event_id long, place long", "n long", "append", GroupStateTimeout.NoTimeout)
