"""State of many keys in one state row: a key's own state is small, and each call to the store takes longer than its work.

Keys are dealt by a hash over BUCKETS; a processor is called with a bucket's rows, reads the states of its keys at once, and
writes them back at once, with one timer for all.  What a call holds is a bucket's state, a BUCKETS-th of what all keys hold,
and no less than one key's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

BUCKETS = 1024


def bucket(key: str, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).alias("bucket")


class Bucketed(StatefulProcessor):
    """A subclass gives what happens to one key: take() for new rows, go_on() for a key whose time has come (both return
    rows to send on and the key's new state), and due(), the watermark from which go_on() is called."""

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "keys binary, timer long")

    def take(self, key, state, rows: list, watermark: int) -> tuple[list[Row], object]:
        raise NotImplementedError

    def go_on(self, key, state, watermark: int) -> tuple[list[Row], object]:
        raise NotImplementedError

    def due(self, state, watermark: int) -> int | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict = {}
        for r in rows:
            new.setdefault(r.key, []).append(r)
        yield from self._all(new, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._all({}, timerValues.getCurrentWatermarkInMs(), True)

    def _all(self, new: dict, watermark: int, expired: bool) -> Iterator[Row]:
        kept, timer = self.states.get() or (None, None)
        states, first = {} if kept is None else pickle.loads(bytes(kept)), None
        for key, rows in new.items():
            out, states[key] = self.take(key, states.get(key), rows, watermark)
            yield from out
        for key, state in states.items():
            at = self.due(state, watermark)
            if at is not None and at <= watermark and key not in new:
                out, states[key] = self.go_on(key, state, watermark)
                yield from out
                at = self.due(states[key], watermark)
            if at is not None:
                at = max(at, watermark + 1)  # in a call to come
                first = at if first is None else min(at, first)
        if timer is not None and timer != first and not expired:
            self.handle.deleteTimer(timer)
        if first is not None and (first != timer or expired):
            self.handle.registerTimer(first)
        self.states.update((pickle.dumps(states, pickle.HIGHEST_PROTOCOL), first))

    def close(self) -> None:
        pass


def by_bucket(rows: DataFrame, processor: Bucketed, schema: str) -> DataFrame:
    """What the processor sends on of a stream of (key, ..., ts) with a watermark."""
    return rows.select(bucket("key"), "*").groupBy("bucket").transformWithState(processor, schema, "Append", "EventTime")
