"""Shared pieces: vectorised hashing of words and windows, batches of documents, packed exchanges.

Most operators here run the same three-step plan.  Documents are dealt by a hash of their id into *batches*
of about ``BATCH_BYTES`` of text, in one exchange that later steps reuse.  A batch sends compact, already
pre-aggregated digests to hash *buckets* (one entry for a digest and batch, however often it occurs there, so a
frequent line or passage costs a bucket at most one entry a batch), a bucket decides, and its answers go back to
the batches.  The number of batches and buckets follows the size of the input; each is of bounded size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes a batch holds on average; one document is never split.
BATCH_BYTES = 8 << 20
#: Entries a bucket receives on average.
BUCKET_ENTRIES = 4_000_000
#: Text bytes looked at at once; bounds the working arrays for very long texts.
PIECE_BYTES = 1 << 19

#: Pattern of a word, as Spark and Java read it.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\r\x0b\x0c"
#: Stands for a null doc_id in comparisons: null ids are larger than all others.
NO_ID = (1 << 63) - 1

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GOLDEN = U(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(size, b, U)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, math.ceil(math.log2(max(size, 2)))))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts:
    """The UTF-8 bytes of a column of strings, end to end; nulls are empty."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):  # nothing in it
                column = pa.array([], pa.string())
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        n, off = len(column), column.offset
        _, offsets, data = column.buffers()
        if n == 0 or offsets is None:
            self.offsets, self.data = np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
            return
        o = np.frombuffer(offsets, np.int64 if wide else np.int32)[off : off + n + 1].astype(np.int64)
        all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = all_bytes[o[0] : o[-1]]
        self.offsets = o - o[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def spans(self, separators: np.ndarray | None = None):
        """(starts, ends) of the words, a piece of PIECE_BYTES at a time, so a word of any length costs no more memory
        than others.  separators replaces white space.  A word ends with its text."""
        space, n, at = IS_SPACE if separators is None else separators, len(self.data), 0
        opened, inside = np.zeros(0, np.int64), False
        while at < n:
            end = min(at + PIECE_BYTES, n)
            word = ~space[self.data[at:end]]
            new_text = np.zeros(end - at, bool)
            lo, hi = np.searchsorted(self.offsets, [at, end])
            new_text[self.offsets[lo:hi] - at] = True
            before = np.empty_like(word)
            before[0], before[1:] = inside, word[:-1]
            starts = np.concatenate([opened, np.flatnonzero(word & (~before | new_text)) + at])
            ends = np.flatnonzero(before & (~word | new_text)) + at
            inside, at = bool(word[-1]), end
            if at == n and inside:
                ends = np.append(ends, n)
            opened = starts[len(ends) :]
            yield starts[: len(ends)], ends

    def words(self, lower: bool = False, separators: np.ndarray | None = None):
        """Hash of each word, and index of each text's first word (one more at the end)."""
        hashes, starts = [], []
        reader = _Eights(self.data, lower)
        for s, e in self.spans(separators):
            hashes.append(reader.hashes(s, e))
            starts.append(s)
        where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(where, self.offsets)


class _Eights:
    """Hashes of byte ranges.  Up to SHORT bytes they are read eight at a time, each eight mixed into a chain of
    bijections that starts from the length (so ranges of at most eight bytes never collide); longer ranges take XXH3."""

    SHORT = 64

    def __init__(self, data: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = e - s
        h = mix(n.astype(U) * GOLDEN)
        left, who = np.minimum(n, self.SHORT), np.arange(len(n))
        for k in range(0, self.SHORT, 8):
            if k:
                who = who[left[who] > k]
            if not len(who):
                break
            some = self.at[s[who] + k]
            cut = np.maximum(8 - (left[who] - k), 0).astype(U) * U(8)
            h[who] = mix(h[who] ^ mix((some << cut) + U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))))
        for i in np.flatnonzero(n > self.SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(memoryview(self.data)[s[i] : e[i]])
        return h


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive words, over document ends too (see inside)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(WORD_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n] + U(size))


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Whether the window at each start lies in one document."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    return np.arange(n) + size <= first[1:][doc_of(first)[:n]]


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted among, and where."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at


def groups(order_by: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(order_by):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], order_by[1:] != order_by[:-1]]))


def joined(column, dtype) -> np.ndarray:
    """All blobs of a binary column as one array."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def sizes(column, width: int) -> np.ndarray:
    """Entries in each blob of a binary column."""
    return np.array([len(x.as_buffer()) // width for x in column], np.int64)


def runs(order_by: np.ndarray):
    """(from, to) of the runs of equal values in a sorted array; none of an empty one."""
    at = groups(order_by).tolist()
    return zip(at, [*at[1:], len(order_by)] if at else [], strict=True)


def buckets_of(sorted_bucket: np.ndarray):
    """(bucket, from, to) for each run in a sorted array of bucket numbers."""
    for i, j in runs(sorted_bucket):
        yield int(sorted_bucket[i]), i, j


def ids(table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0


class Plan:
    """Documents dealt into batches, and the number of buckets for a number of entries."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = BATCH_BYTES, keep: tuple[str, ...] = ()):
        spark = docs.sparkSession
        self.bytes = text_bytes(docs, text)
        self.n_batches = max(1, math.ceil(self.bytes / batch_bytes))
        parts = max(partitions(spark), 1)
        self.docs = docs.select(
            F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep,
            F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(17)), F.lit(self.n_batches)).cast("int").alias("batch"),
        ).repartition(parts, "batch")

    def buckets(self, entries_per_byte: float) -> int:
        return max(1, math.ceil(self.bytes * entries_per_byte / BUCKET_ENTRIES))

    def emit(self, f, schema: str) -> DataFrame:
        """f(batch's documents) for each batch."""
        return self.docs.groupBy("batch").applyInArrow(f, schema)

    def answer(self, answers: DataFrame, f, schema: str) -> DataFrame:
        """f(batch's documents, batch's answers) for each batch; a batch without answers gets none of them."""
        return self.docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(f, schema)


def decide(sent: DataFrame, f, schema: str) -> DataFrame:
    """f(all that a bucket was sent)."""
    return sent.groupBy("bucket").applyInArrow(f, schema)


def table_of(schema: pa.Schema, rows: dict) -> pa.Table:
    return pa.table({f.name: pa.array(rows[f.name], f.type) if not isinstance(rows[f.name], pa.Array) else rows[f.name].cast(f.type) for f in schema}, schema=schema)


def portions(batches, column: str = "text", most: int = 1 << 20):
    """The record batches in slices of about most bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        offsets = Texts(batch.column(column)).offsets
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, min(end, batch.num_rows) - at)
            at = end
