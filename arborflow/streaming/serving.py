"""Serving of points as a stateful stream, with transformWithState.

A key (a user) sends points; those that come within `gap` of each other form a *session* of at most `room` points, as a cache
has a fixed number of places.  When a session is over, because a later point came after the gap, because it is full, or
because the watermark has passed its end, its points are served in turn: one step each, and a point with steps left goes
back to the end of the queue.  State of a key: the waiting points, the points being served in the order of the queue, how
many points of a kind the key has had, and counters; keys are held by buckets (see `buckets`).  A timer ends a session without
further points, and then serves `SLICE` steps of a key at each call.

Points of a key are taken by (time, id); what a micro-batch holds does not matter as long as no point is later than the
watermark's delay.  Later ones are dropped, as by any watermark.  A key's state is bounded by `room`; a key's work is one
task's, as its queue is one sequence.  Null keys are a key; rows without time are dropped by the watermark.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .buckets import Bucketed, by_bucket

#: Steps that a timer's call serves.
SLICE = 64
SERVED = "key long, session long, id long, seat long, nth_of_kind long, steps long, finish_step long"
OUT = Row("key", "session", "id", "seat", "nth_of_kind", "steps", "finish_step")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Serving(Bucketed):
    """Rows (key, id, at, kind, steps), at in milliseconds.  A key's state: the last point's time, the waiting points (id,
    seat, nth, steps), the queue being served (session, id, seat, nth, steps, left), the step it is at, and counts of kinds."""

    def __init__(self, gap_ms: int, room: int, steps: int = SLICE):
        self.gap, self.room, self.most = gap_ms, room, steps

    def _serve(self, key, queue: list, step: int, most: int | None) -> tuple[list, list, int]:
        """Up to `most` steps: the rows of points that finish, the queue after them, and the number of the last step."""
        out, at, done = [], 0, 0
        queue = list(queue)
        while at < len(queue) and (most is None or done < most):
            session, i, seat, nth, steps, left = queue[at]
            step, done, at = step + 1, done + 1, at + 1
            if left == 1:
                out.append(OUT(key, session, i, seat, nth, steps, step))
            else:
                queue.append((session, i, seat, nth, steps, left - 1))
        return out, queue[at:], step

    def take(self, key, state, rows, watermark):
        last, waiting, queue, step, counts = state or (None, [], [], 0, {})
        out = []
        for at, i, kind, steps in sorted((r.at, r.id, r.kind or "", r.steps) for r in rows):
            if waiting and (at - last > self.gap or len(waiting) == self.room):
                # the session before it goes first; its last steps come in one call, as its end is in the past
                out += self._serve(key, queue, step, None)[0]
                queue, step, waiting = self._seated(waiting), 0, []
            counts[kind] = counts.get(kind, 0) + 1
            waiting.append((i, len(waiting), counts[kind], steps))
            last = at
        more, queue, step = self._serve(key, queue, step, self.most)
        return out + more, (last, waiting, queue, step, counts)

    def go_on(self, key, state, watermark):
        last, waiting, queue, step, counts = state
        if not queue and waiting and watermark > last + self.gap:
            queue, step, waiting = self._seated(waiting), 0, []
        out, queue, step = self._serve(key, queue, step, self.most)
        return out, (last, waiting, queue, step, counts)

    @staticmethod
    def _seated(waiting: list) -> list:
        """A session's points as its queue; a session has the id of its first point."""
        return [(waiting[0][0], i, seat, nth, steps, steps) for i, seat, nth, steps in waiting]

    def due(self, state, watermark):
        """At the next call while points are served, else at the session's end, if points wait."""
        last, waiting, queue, _, _ = state
        return watermark if queue else last + self.gap + 1 if waiting else None


def serve_points(points: DataFrame, gap_seconds: int, room: int, delay: str = "0 seconds", steps: int = SLICE) -> DataFrame:
    """(key, session, id, seat, nth_of_kind, steps, finish_step) of a stream of (key, id, ts, kind, steps), steps at
    least 1; null kinds are the kind ""."""
    rows = points.withWatermark("ts", delay)
    rows = rows.select("key", "id", F.unix_millis("ts").alias("at"), "kind", "steps", "ts")
    return by_bucket(rows, Serving(gap_seconds * 1000, room, steps), SERVED)


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that transformWithState needs, for streams started inside."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, was)
