"""Token ids of texts, by the vocabulary file of a public tokenizer: .json (tokenizers) or .model (sentencepiece)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, or of ids, that are encoded or decoded at once: what a call holds besides its batch is some hundred
#: bytes a token.
PIECE = 1 << 19


def _pieces(*columns: pa.Array, most: int) -> Iterator[tuple[pa.Array, ...]]:
    """Runs of rows of about `most` bytes, one row at least."""
    n, at = len(columns[0]), 0
    ends = sum(np.cumsum(np.asarray(_lengths(c), dtype=np.int64)) for c in columns)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield tuple(c.slice(at, to - at) for c in columns)
        at = to


def _lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each row, 0 for nulls."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) * 8
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """array<long> of rows, without an object for each number."""
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)], dtype=np.int32)
    values = [r for r in rows if r is not None]
    flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([r is None for r in rows], pa.bool_()))


@lru_cache(maxsize=4)
def _load(name: str):
    """(encode a list of texts, decode a list of id lists) of a shipped file, once a worker."""
    path = SparkFiles.get(name)
    if name.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], lambda ids: t.decode_batch(ids, skip_special_tokens=False)
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return lambda texts: p.encode(texts, num_threads=1), p.decode


class Tokenizer:
    """Encodes and decodes columns; the file, some megabytes, is shipped to the executors once."""

    def __init__(self, spark: SparkSession, path: str, start: int | None = None):
        """start: the id that begins each sequence, if any."""
        if not path.endswith((".json", ".model")):
            raise ValueError(f"no reader for the vocabulary {path}")
        spark.sparkContext.addFile(path)
        self.name, self.start = os.path.basename(path), start

    def encode(self, text: Column) -> Column:
        """array<long>; null stays null."""
        name, front = self.name, self._front()

        @F.arrow_udf("array<long>")
        def f(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = _load(name)[0]
            for t in texts:
                for (some,) in _pieces(t, most=PIECE):
                    yield _lists(_encoded(encode, some.to_pylist(), front))

        return f(text)

    def _front(self) -> list[int]:
        return [] if self.start is None else [self.start]

    def encode_parts(self, first: Column, second: Column, trim: int = 1) -> Column:
        """first's ids, then second's without its leading trim ids.  Not the ids of the joined text: merges do not cross
        the seam, so a first part that rows next to each other share is encoded once."""
        name, front = self.name, self._front()

        @F.arrow_udf("array<long>")
        def f(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            encode, last, ids = _load(name)[0], None, None
            for pair in parts:
                for some, more in _pieces(*pair, most=PIECE):
                    out = []
                    for text, behind in zip(some.to_pylist(), _encoded(encode, more.to_pylist(), front), strict=True):
                        if text != last:
                            last, ids = text, _encoded(encode, [text], front)[0]
                        out.append(None if ids is None or behind is None else np.concatenate([ids, behind[trim:]]))
                    yield _lists(out)

        return f(first, second)

    def decode(self, ids: Column, skip: tuple[int, ...] = ()) -> Column:
        """The text of ids without those in skip; null stays null."""
        name = self.name

        @F.arrow_udf("string")
        def f(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decode = _load(name)[1]
            for r in rows:
                for (some,) in _pieces(r, most=PIECE):
                    lists = some.to_pylist()
                    texts = iter(decode([x for x in lists if x is not None]))
                    yield pa.array([None if x is None else next(texts) for x in lists], pa.string())

        return f(F.filter(ids, lambda x: ~x.isin(*skip)) if skip else ids)


def _encoded(encode, texts: list[str | None], front: list[int]) -> list[np.ndarray | None]:
    ids = iter(encode([t for t in texts if t is not None]))
    return [None if t is None else np.array(front + next(ids), dtype=np.int64) for t in texts]
