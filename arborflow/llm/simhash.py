"""SimHash near-dedup with pigeonring filtering.

Fingerprints are cut into ``SEGMENTS`` equal segments in a ring.  If two of them differ in at most d bits, some chain
of consecutive segments has, for every length l, at most floor(l * d / SEGMENTS) differing bits in its first l
segments (the pigeonring principle, a stronger form of the pigeonhole one).  Chains of two segments become hash keys:
the index holds each fingerprint under its own two segments, a probe asks for each variant within the budgets.
Meeting fingerprints must satisfy the longer chains as well before the full Hamming check.

Within a key, verified fingerprints are linked by a spanning forest and not by all pairs, so a large group of near
copies costs a number of links in proportion to its size.  Equal fingerprints are one node throughout.

Rows with equal doc_id are documents of their own.  Columns other than doc_id and text are left aside; an empty table gives
no rows.  A text is read whole and its words are held at once, so a very long one takes memory in proportion to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components, hub_join
from .tables import saved

U = np.uint64
SEGMENTS, WIDTH = 4, 16
MASK = U((1 << WIDTH) - 1)
#: Fingerprints per key bucket on average.
BUCKET_PROBES = 2_000_000
SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SENT = pa.schema([("bucket", pa.int32()), ("fp", pa.binary()), ("code", pa.binary())])


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter((h(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)), U, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def sign(shingle: int):
    def f(batches):
        for batch in batches:
            texts = C.Texts(batch.column("text"))
            fps = np.fromiter((fingerprint(texts.text(i), shingle) for i in range(len(texts))), U, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], schema=SIGNED)

    return f


def _variants(distance: int) -> np.ndarray:
    """Masks of the second segment within the budget of a chain of two whose first segment is equal."""
    assert distance * 1 // SEGMENTS == 0, "the first segment must be equal"
    return np.array([0] + [1 << i for i in range(WIDTH)] * (2 * distance // SEGMENTS >= 1), U)


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> U(WIDTH * (i % SEGMENTS))) & MASK


def _key(fp: np.ndarray, code: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The key that a code asks for: code = start * 32 + variant; variant 31 is the index's own entry."""
    start, variant = (code >> 5).astype(U), code & 31
    first = (fp >> (start * U(WIDTH))) & MASK
    second = (fp >> ((start + U(1)) % U(SEGMENTS) * U(WIDTH))) & MASK
    flip = masks[np.where(variant == 31, 0, variant)]
    return (start << U(2 * WIDTH)) | (first << U(WIDTH)) | (second ^ flip)


def send_keys(distance: int, buckets: int):
    masks = _variants(distance)
    codes = np.array([s * 32 + v for s in range(SEGMENTS) for v in (*range(len(masks)), 31)], np.uint8)

    def f(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(U)
            for i in range(0, len(fps), 4096):
                fp = np.repeat(fps[i : i + 4096], len(codes))
                code = np.tile(codes, len(fps[i : i + 4096]))
                bucket = C.mix(_key(fp, code, masks)) % U(buckets)
                order = np.argsort(bucket, kind="stable")
                rows = {x: [] for x in SENT.names}
                for b, j, k in C.buckets_of(bucket[order]):
                    for x, v in zip(SENT.names, (b, fp[order[j:k]].tobytes(), code[order[j:k]].tobytes()), strict=True):
                        rows[x].append(v)
                yield from C.table_of(SENT, rows).to_batches()

    return f


def close(x: np.ndarray, y: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether fingerprints satisfy every chain from start, and then the whole distance."""
    diff, total, ok = x ^ y, 0, True
    for l in range(1, SEGMENTS + 1):  # noqa: E741
        total = total + np.bitwise_count(_segment(diff, start + l - 1)).astype(np.int16)
        ok = ok & (total <= l * distance // SEGMENTS)
    return ok


def _forest(own: np.ndarray, probes: np.ndarray, start: int, distance: int, out: list) -> None:
    """Edges of a spanning forest of the close (own, probe) pairs of a key.  Every own entry is a probe as well.
    Works through a frontier: each node is taken up once and compared with the nodes not yet reached."""
    left = np.unique(np.concatenate([own, probes]))
    is_own = np.isin(left, own)
    while len(left):
        queue, (left, is_own) = [(left[0], is_own[0])], (left[1:], is_own[1:])
        while queue and len(left):
            node, mine = queue.pop()
            hit = close(left, node, start, distance) & (is_own | mine)
            if hit.any():
                new = left[hit]
                out.append(np.stack([np.full(len(new), node), new]))
                queue.extend(zip(new, is_own[hit], strict=True))
                left, is_own = left[~hit], is_own[~hit]


def link(distance: int):
    masks = _variants(distance)

    def f(sent: pa.Table) -> pa.Table:
        fp, code = C.joined(sent.column("fp"), U), C.joined(sent.column("code"), np.uint8)
        key = _key(fp, code, masks)
        own = (code & 31) == 31
        order = np.lexsort((~own, key))
        key, fp, own = key[order], fp[order], own[order]
        at = C.groups(key)
        size = np.diff(np.append(at, len(key)))
        out: list = []
        # an index entry always meets its own probe, so two entries of one fingerprint are no pair
        busy = np.flatnonzero(own[at] & (size > 2))
        small = busy[size[busy] == 3]
        if len(small):
            s = at[small]
            two = own[s + 1]  # two entries and a probe, or one entry and two probes
            for pair in ((s, s + 1), (s, s + 2), (s + 1, s + 2)):
                x, y, start = fp[pair[0]], fp[pair[1]], key[pair[0]] >> U(2 * WIDTH)
                fine = (own[pair[0]] | own[pair[1]]) & (x != y)
                for i in range(SEGMENTS):
                    m = fine & (start == U(i))
                    if m.any():
                        m[m] = close(x[m], y[m], i, distance)
                        out.append(np.stack([x[m], y[m]]))
            del two
        for g in busy[size[busy] > 3]:
            i, j = at[g], at[g] + size[g]
            n_own = int(own[i:j].sum())
            _forest(fp[i : i + n_own], fp[i + n_own : j], int(key[i] >> U(2 * WIDTH)), distance, out)
        e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), U)
        a, b = e.view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]}, schema=EDGES)

    return f


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for each row; a null text has no words."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(sign(shingle), "doc_id long, fp long")


def named_components(signed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for the rows of signed (doc_id, fp), from nodes (fp, least) and links a - b of fps."""
    member = components(edges)
    of_fp = nodes.join(member, nodes.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = of_fp.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_fp = hub_join(of_fp, named, "component", nodes.count()).select("fp", "component_id")
    return signed.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, itself included) for each row of docs.
    A null doc_id gets the component of its fingerprint and never names one, unless it is alone (then null)."""
    signed = saved(fingerprints(docs, shingle, text, key), "fingerprints")
    nodes = saved(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    per_fp = SEGMENTS * (len(_variants(distance)) + 1)
    buckets = max(1, -(-nodes.count() * per_fp // BUCKET_PROBES))
    sent = nodes.select("fp").mapInArrow(send_keys(distance, buckets), "bucket int, fp binary, code binary")
    edges = C.decide(sent, link(distance), "a long, b long")
    return named_components(signed, nodes, edges)
