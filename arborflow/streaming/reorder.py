"""A reorder buffer: what arrives out of sequence is held, and leaves in sequence.

Rows of a key carry a sequence number from 0 on.  A row whose turn it is leaves at once, with those behind it that are held;
an early one waits in the key's state.  If the watermark passes a waiting row's arrival by `patience`, the numbers that
are missing before it are given up, and all held rows up to it leave.  So nothing waits for ever, and no row leaves before
one with a smaller number that came within the patience.

Every row leaves once.  place counts the rows of a key that left in sequence, skipped the numbers given up right before a
row; both are null for a row that came after its turn had passed, or again.  State is bounded by what arrives within the
patience.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .buckets import Bucketed, by_bucket

RELEASED = "key long, seq long, place long, skipped long, payload string"
OUT = Row("key", "seq", "place", "skipped", "payload")


class Reorder(Bucketed):
    """Rows (key, seq, at, payload), at in milliseconds.  A key's state: the number whose turn is next, how many rows left
    in sequence, and the waiting rows {seq: (at, payload)}."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def take(self, key, state, rows, watermark):
        next_, place, held = state or (0, 0, {})
        late = []
        for at, seq, payload in sorted(((r.at, r.seq, r.payload) for r in rows), key=lambda x: (x[1], x[0], x[2] is None, x[2] or "")):
            if seq < next_ or seq in held:
                late.append(OUT(key, seq, None, None, payload))
            else:
                held[seq] = at, payload
        out, state = self.go_on(key, (next_, place, held), watermark)
        return late + out, state

    def go_on(self, key, state, watermark):
        """The rows whose turn has come leave."""
        next_, place, held = state
        given_up = max((s for s, (at, _) in held.items() if at + self.patience < watermark), default=-1)
        out = []
        for s in sorted(held):
            if s != next_ and s > given_up:
                break
            out.append(OUT(key, s, place, s - next_, held.pop(s)[1]))
            next_, place = s + 1, place + 1
        return out, (next_, place, held)

    def due(self, state, watermark):
        held = state[2]
        return min(at for at, _ in held.values()) + self.patience + 1 if held else None


def in_sequence(rows: DataFrame, patience_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(key, seq, place, skipped, payload) of a stream of (key, seq, ts, payload), seq from 0 on."""
    some = rows.withWatermark("ts", delay).select("key", "seq", F.unix_millis("ts").alias("at"), "payload", "ts")
    return by_bucket(some, Reorder(patience_seconds * 1000), RELEASED)
