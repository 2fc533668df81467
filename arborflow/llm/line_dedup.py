"""Line dedup with two Bloom filters.

Every batch of documents builds two partial filters over the digests of its lines: one of digests seen once, one of those
that two or more of its documents hold.  Their bits, cut into ranges, are all that shuffles: a bucket merges the partial
filters of its range (seen twice are bits that were set already, or that a batch saw twice) and tells each batch which
of its bits are set in the second filter.  Only lines all of whose bits are there, the suspected repeats, are sent on
with their whole keys, for exact confirmation and the choice of the smallest document.  A false hit of a filter costs a
little traffic and changes no result.

A text has to meet the answers on its lines, so texts are dealt into batches once; no later step moves them.

A null or empty text is one empty line.  A null doc_id counts as larger than all others.  Rows with equal doc_id
count as one document for the number of documents that hold a line.  A text's lines are held one text at a time; a very
long text or line takes memory in proportion to it in its own task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from . import common as C

U = np.uint64
#: Bits of a range of a filter, lines that it is for, and bits that a line sets in it.
RANGE_BITS, RANGE_LINES, HASHES = 1 << 26, 1 << 21, 2
#: Bytes of text a line is taken to have when ranges are counted, and suspected keys a bucket confirms on average.
LINE_BYTES, SUSPECTS = 40, 250_000
SENT = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
SUSPECT = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("hit", pa.binary())])
EXACT = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("keys", pa.list_(pa.binary())), ("doc", pa.binary()), ("many", pa.binary())])
FIRST = pa.schema([("batch", pa.int32()), ("keys", pa.list_(pa.binary())), ("doc", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def bits_of(h: np.ndarray) -> np.ndarray:
    """The bits of a range that digests set, shape (HASHES, digests)."""
    return np.stack([(C.mix(h + U(k) * C.GOLDEN) % U(RANGE_BITS)).astype(np.uint32) for k in range(HASHES)])


def sparse(bits: np.ndarray) -> bytes:
    """Sorted distinct bits of a range: few as they are, many as the number in each block of 2**16 and then their low
    halves; none as nothing.  So what a batch sends follows its bits, however many ranges there are."""
    if 4 * len(bits) <= (RANGE_BITS >> 14) + 2 * len(bits):
        return b"\0\0\0\0" + bits.astype(np.uint32).tobytes() if len(bits) else b""
    counts = np.bincount(bits >> 16, minlength=RANGE_BITS >> 16).astype(np.uint32)
    return b"\1\0\0\0" + counts.tobytes() + bits.astype(np.uint16).tobytes()


def unsparse(blob) -> np.ndarray:
    data = np.frombuffer(blob, np.uint8)
    if not len(data) or not data[0]:
        return data[4:].view(np.uint32)
    blocks = RANGE_BITS >> 16
    n = data[4 : 4 + 4 * blocks].view(np.uint32)
    return np.repeat(np.arange(blocks, dtype=np.uint32) << np.uint32(16), n) | data[4 + 4 * blocks :].view(np.uint16)


class Bloom:
    """RANGE_BITS bits."""

    def __init__(self):
        self.words = np.zeros(RANGE_BITS // 8, np.uint8)

    def add(self, bits: np.ndarray) -> None:
        np.bitwise_or.at(self.words, bits >> 3, np.left_shift(np.uint8(1), (bits & 7).astype(np.uint8)))

    def holds(self, bits: np.ndarray) -> np.ndarray:
        return self.words[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 == 1


def merge(partial: list[tuple[np.ndarray, np.ndarray]]) -> Bloom:
    """The filter of digests seen twice, from partial filters (once, twice) of different batches."""
    once, twice = Bloom(), Bloom()
    for seen, again in partial:
        twice.add(seen[once.holds(seen)])
        twice.add(again)
        once.add(seen)
    return twice


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has fewer than least code points."""
    k = line.strip(C.WHITE).lower()
    if len(k) < least or (len(k) < 4 * least and len(k.decode("utf-8", "replace")) < least):
        return None
    return k


def _keys(docs: pa.Table, least: int) -> dict[bytes, tuple[int, int]]:
    """The smallest and largest document of a batch for each key."""
    texts, out = C.Texts(docs.column("text")), {}
    for i, d in enumerate(C.ids(docs).tolist()):
        for line in texts.text(i).split(b"\n"):
            if (k := line_key(line, least)) is not None:
                lo, hi = out.get(k, (d, d))
                out[k] = (lo if lo < d else d, hi if hi > d else d)
    return out


def _digests(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), U, len(keys))


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (h >> U(40)) % U(buckets)
    return bucket, np.argsort(bucket, kind="stable")


def send_filters(least: int, buckets: int):
    def f(docs: pa.Table) -> pa.Table:
        found = _keys(docs, least)
        h = _digests(found)
        many = np.fromiter((lo != hi for lo, hi in found.values()), bool, len(found))
        bucket, order = _by_bucket(h, buckets)
        rows = {x: [] for x in SENT.names}
        for b, i, j in C.buckets_of(bucket[order]):
            mine = order[i:j]
            once, twice = (sparse(np.unique(bits_of(x))) for x in (h[mine], h[mine[many[mine]]]))
            for x, v in zip(SENT.names, (docs.column("batch")[0].as_py(), b, once, twice), strict=True):
                rows[x].append(v)
        return C.table_of(SENT, rows)

    return f


def find_suspects(sent: pa.Table) -> pa.Table:
    """Which bits of a batch's first filter are set in the merged second one, in their order."""
    twice = merge([(unsparse(a.as_buffer()), unsparse(b.as_buffer())) for a, b in zip(sent.column("once"), sent.column("twice"), strict=True)])
    rows = {x: [] for x in SUSPECT.names}
    for batch, bucket, blob in zip(sent.column("batch").to_pylist(), sent.column("bucket").to_pylist(), sent.column("once"), strict=True):
        hit = twice.holds(unsparse(blob.as_buffer()))
        if hit.any():
            for x, v in zip(SUSPECT.names, (batch, bucket, np.packbits(hit).tobytes()), strict=True):
                rows[x].append(v)
    return C.table_of(SUSPECT, rows)


def send_suspects(least: int, buckets: int, spread: int):
    def f(docs: pa.Table, suspects: pa.Table) -> pa.Table:
        rows = {x: [] for x in EXACT.names}
        if docs.num_rows and suspects.num_rows:
            found = _keys(docs, least)
            keys, h = list(found), _digests(found)
            hits = dict(zip(suspects.column("bucket").to_pylist(), suspects.column("hit"), strict=True))
            bucket, order = _by_bucket(h, buckets)
            pick = [np.zeros(0, np.int64)]
            for b, i, j in C.buckets_of(bucket[order]):
                if b in hits:
                    bits = bits_of(h[order[i:j]])
                    mine, at = np.unique(bits, return_inverse=True)
                    hit = np.unpackbits(np.frombuffer(hits[b].as_buffer(), np.uint8), count=len(mine)).astype(bool)
                    pick.append(order[i:j][hit[at.reshape(bits.shape)].all(axis=0)])
            pick = np.concatenate(pick)
            bucket, order = _by_bucket(h[pick], spread)
            for b, i, j in C.buckets_of(bucket[order]):
                mine = [keys[x] for x in pick[order[i:j]]]
                lo, hi = np.array([found[k] for k in mine], np.int64).T
                for x, v in zip(EXACT.names, (docs.column("batch")[0].as_py(), b, mine, lo.tobytes(), (lo != hi).astype(np.uint8).tobytes()), strict=True):
                    rows[x].append(v)
        return C.table_of(EXACT, rows)

    return f


def confirm(sent: pa.Table) -> pa.Table:
    """The smallest document of each key that two documents or more hold.  Keys are compared as they are."""
    n = np.array(pc.list_value_length(sent.column("keys").combine_chunks()).to_numpy(zero_copy_only=False), np.int64)
    keys = pc.list_flatten(sent.column("keys").combine_chunks().cast(pa.large_list(pa.large_binary())))
    doc, many = C.joined(sent.column("doc"), np.int64), C.joined(sent.column("many"), np.uint8)
    code = keys.dictionary_encode()
    number, kinds = code.indices.to_numpy(), len(code.dictionary)
    least, most, again = np.full(kinds, C.NO_ID), np.full(kinds, -1 << 63), np.zeros(kinds, bool)
    np.minimum.at(least, number, doc)
    np.maximum.at(most, number, doc)
    again[number[many > 0]] = True
    several = again | (least != most)
    rows = {x: [] for x in FIRST.names}
    for batch, i, m in zip(sent.column("batch").to_pylist(), np.cumsum(n) - n, n, strict=True):
        mine = np.arange(i, i + m)
        mine = mine[several[number[mine]]]
        if len(mine):
            for x, v in zip(FIRST.names, (batch, keys.take(pa.array(mine)).to_pylist(), least[number[mine]].tobytes()), strict=True):
                rows[x].append(v)
    return C.table_of(FIRST, rows)


def drop_lines(least: int):
    def f(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        first: dict[bytes, int] = {}
        for keys, doc in zip(firsts.column("keys").to_pylist(), firsts.column("doc").to_pylist(), strict=True):
            first.update(zip(keys, np.frombuffer(doc, np.int64).tolist(), strict=True))
        texts = C.Texts(docs.column("text"))
        rows = {x: [] for x in OUT.names}
        for i, (doc_id, d) in enumerate(zip(docs.column("doc_id").to_pylist(), C.ids(docs).tolist(), strict=True)):
            lines = texts.text(i).split(b"\n")
            kept = [x for x in lines if (k := line_key(x, least)) is None or first.get(k, d) == d]
            for x, v in zip(OUT.names, (doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept)), strict=True):
                rows[x].append(v)
        return C.table_of(OUT, rows)

    return f


def line_dedup(docs: DataFrame, least: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the lines left, joined by a line feed) for each row of docs.  Lines whose
    key (white space stripped, A-Z lower-cased, at least ``least`` code points) several documents hold stay only in
    the document with the smallest key."""
    plan = C.Plan(docs, text, key)
    buckets = max(1, -(-plan.bytes // (LINE_BYTES * RANGE_LINES)))
    sent = plan.emit(send_filters(least, buckets), "batch int, bucket int, once binary, twice binary")
    suspects = C.decide(sent, find_suspects, "batch int, bucket int, hit binary")
    spread = max(1, -(-plan.bytes // (LINE_BYTES * SUSPECTS)))
    exact = plan.answer(suspects, send_suspects(least, buckets, spread), "batch int, bucket int, keys array<binary>, doc binary, many binary")
    firsts = C.decide(exact, confirm, "batch int, keys array<binary>, doc binary")
    return plan.answer(firsts, drop_lines(least), "doc_id long, n_lines long, n_dropped long, kept string")
