"""Near copies at a similarity of word shingles: SimHash chains and the pigeonring filter find candidates, sets decide.

Two texts whose sets of shingles have the Jaccard similarity s differ in a share p = acos(2s / (1 + s)) / pi of the bits
of a SimHash (for sets of about one size).  At s = 0.8 that is 0.15 of the bits, too many for a 64-bit fingerprint with
a small Hamming limit, so here a signature has two parts:

- chains of ``BITS`` bits.  A pair at the similarity agrees in a whole chain with probability (1 - p)**BITS, and there are
  as many disjoint chains as make a pair meet with probability ``RECALL``: 121 of 20 bits at 0.8, whatever the number of
  documents.  An entry is a key of 4 bytes, the text's name and one word of 64 bits;
- ``CHECK`` words that filter a meeting pair.  Of entries that meet in a key, the first word must differ in at most p of its
  bits and ``WORD_SLACK``; what such pairs connect is a *group*.  A group's texts fetch the other words and are compared by
  the pigeonring filter (from some segment on, every run of l segments differs in at most l shares of the limit) and the
  whole Hamming distance, at most p + ``SLACK`` of the bits.

Links are kept only of pairs that passed all checks, as spanning forests: a forest has the components of all pairs that
pass, so none is lost by it, and a large group of near copies costs links in proportion to its size.  The components
only say which texts may be copies: in each one the texts' sets of different shingles are compared, and only pairs whose
exact Jaccard similarity reaches the limit are linked.  A component's shingles are held by one task: a group of near copies of a
very large number of different texts needs a task with that much memory.  Equal signatures (equal words among others) are
one node throughout.  Random pairs that meet in a key grow with the square of the documents over 2**BITS; BITS is the
parameter for larger corpora (24 bits take 236 chains).

A null text has no words; texts without words are copies of each other, and a text of fewer words than a shingle is one
shingle.  Repeats of a shingle count once.  Letters A-Z are lower-cased.  Shingles and signatures are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .simhash import named_components
from .tables import remove, saved

U = np.uint64
#: Words of 64 bits, and ring segments, that check a pair.
CHECK = 8
#: Probability that a pair at the similarity meets under some key.
RECALL = 0.99
#: Bits of a chain.
BITS = 20
#: Shares of differing bits allowed over the expected one: 4 standard deviations of it at a similarity of 0.8.
SLACK, WORD_SLACK = 0.0625, 0.18
#: Entries of a key bucket, and members of groups in a bucket, on average.
BUCKET_ENTRIES, BUCKET_MEMBERS = 2_000_000, 500_000
#: Keys and groups of up to so many are compared together in arrays, larger ones one by one; the components are the same.
TOGETHER = 8
#: Pairs that a forest compares at once.
BLOCK = 4096
GOLDEN = U(0x9E3779B97F4A7C15)
SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sign", pa.binary()), ("text", pa.string())])
SENT = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("node", pa.binary()), ("word", pa.binary())])
MEMBERS = pa.schema([("group", pa.int64()), ("node", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def differing(similarity: float) -> float:
    """Expected share of differing bits of two texts at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def chains(similarity: float, bits: int = BITS) -> int:
    """Number of chains by which a pair at the similarity meets with probability RECALL."""
    n = math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - differing(similarity)) ** bits)))
    if n << bits > 1 << 32:
        raise ValueError("keys must fit 4 bytes")
    return n


def signature(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """n_words words of 64 bits: the majority of the shingles in each bit."""
    counts = np.zeros(64 * n_words, np.int64)
    salts = np.arange(1, n_words + 1, dtype=U) * GOLDEN
    for i in range(0, len(hashes), 255):  # so many counts fit in a byte
        bits = np.unpackbits(C.mix(hashes[i : i + 255, None] + salts).view(np.uint8), axis=1)
        counts += bits.view(U).sum(axis=0, dtype=U).view(np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(U)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a text's different shingles."""
    if not len(words):
        return np.zeros(0, U)
    return np.unique(C.windows(words, min(size, len(words))))


def sign(shingle: int, n_words: int):
    def f(batches):
        for part in C.portions(batches):
            words, first = C.Texts(part.column("text")).words(lower=True)
            signs = np.zeros((part.num_rows, n_words), U)
            for i in range(part.num_rows):
                signs[i] = signature(shingles(words[first[i] : first[i + 1]], shingle), n_words)
            fp = np.zeros(len(signs), U)
            for x in signs.T:
                fp = C.mix(fp * GOLDEN + x)
            blobs = pa.array([s.tobytes() for s in signs], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), blobs, part.column("text")], schema=SIGNED)

    return f


def send_chains(k: int, n_chains: int, buckets: int):
    weights = U(1) << np.arange(k, dtype=U)
    table = np.arange(n_chains, dtype=U) << U(k)

    def f(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                node = part.column("fp").to_numpy()
                signs = C.joined(part.column("sign"), U).reshape(len(node), -1)
                bits = np.unpackbits(np.ascontiguousarray(signs[:, CHECK:]).view(np.uint8), axis=1)[:, : k * n_chains]
                key = ((bits.reshape(len(node), n_chains, k) * weights).sum(axis=2, dtype=U) | table).ravel()
                row = np.repeat(np.arange(len(node)), n_chains)
                bucket = C.mix(key) % U(buckets)
                order = np.argsort(bucket, kind="stable")
                rows = {x: [] for x in SENT.names}
                for b, i, j in C.buckets_of(bucket[order]):
                    take = order[i:j]
                    for x, v in zip(SENT.names, (b, key[take].astype(np.uint32).tobytes(), node[row[take]].tobytes(), signs[row[take], 0].tobytes()), strict=True):
                        rows[x].append(v)
                yield from C.table_of(SENT, rows).to_batches()

    return f


def near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Whether signatures pass the pigeonring filter and then the whole Hamming check."""
    apart = np.bitwise_count(x ^ y).astype(np.int32)
    ring = np.zeros((len(apart), 2 * CHECK + 1), np.int32)
    np.cumsum(np.concatenate([apart, apart], axis=1), axis=1, out=ring[:, 1:])
    passes = np.ones((len(apart), CHECK), bool)  # from each segment on
    for n in range(1, CHECK + 1):
        passes &= ring[:, n : n + CHECK] - ring[:, :CHECK] <= n * limit // CHECK
    return passes.any(axis=1) & (ring[:, CHECK] <= limit)


def _frontier(at: int, end: int, close, out: list) -> None:
    """Links of a spanning forest of the close pairs among at to end, through a frontier: each is taken up once and compared
    with those not reached yet, several at a time where few are left.  close(x, y): a matrix for indices x and y."""
    left = np.arange(at, end)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            n = min(len(queue), max(1, BLOCK // len(left)))
            x, queue = np.array(queue[:n]), queue[n:]
            hit = np.concatenate([close(x, left[i : i + 16 * BLOCK]) for i in range(0, len(left), 16 * BLOCK)], axis=1)
            got = hit.any(axis=0)
            if got.any():
                out.append(np.stack([x[hit.argmax(axis=0)[got]], left[got]]))
                queue.extend(left[got])
                left = left[~got]


def links(key: np.ndarray, pairs, close) -> np.ndarray:
    """Links, shape (2, n), that connect what the close pairs with equal keys connect.  key is sorted.  pairs(x, y): whether
    they are close, for indices x and y; close: the same for all x with all y."""
    at = C.groups(key)
    size = np.diff(np.append(at, len(key)))
    of = np.repeat(size, size)
    out: list = [np.zeros((2, 0), np.int64)]
    for lag in range(1, TOGETHER):
        x = np.flatnonzero((key[lag:] == key[:-lag]) & (of[lag:] <= TOGETHER))
        x = x[pairs(x, x + lag)] if len(x) else x
        out.append(np.stack([x, x + lag]))
    for g in np.flatnonzero(size > TOGETHER):
        _frontier(int(at[g]), int(at[g] + size[g]), close, out)
    return np.concatenate(out, axis=1)


def reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links a - b reach from each of n."""
    out = np.arange(n)
    while True:
        before = out.copy()
        low = np.minimum(out[a], out[b])
        for x in (a, b):
            np.minimum.at(out, out[x], low)
            np.minimum.at(out, x, low)
        out = out[out]
        if np.array_equal(out, before):
            return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each set of n nodes that links a - b connect: its smallest node with the others."""
    top = reached(n, a, b)
    rest = np.flatnonzero(top != np.arange(n))
    return top[rest], rest


def gather(limit: int):
    """The groups of a bucket: what entries of equal keys, whose words differ in few bits, connect.  A group's name is made
    of its key and its smallest node."""

    def f(sent: pa.Table) -> pa.Table:
        key, node = C.joined(sent.column("key"), np.uint32), C.joined(sent.column("node"), np.int64)
        word = C.joined(sent.column("word"), U)
        order = np.lexsort((node, key))
        key, node, word = key[order], node[order], word[order]
        a, b = links(key, lambda x, y: np.bitwise_count(word[x] ^ word[y]) <= limit, lambda x, y: np.bitwise_count(word[y][None, :] ^ word[x][:, None]) <= limit)
        top = reached(len(key), a, b)
        some = np.flatnonzero(np.bincount(top, minlength=len(key))[top] > 1)
        group = C.mix(C.mix(key[some].astype(U)) ^ node[top[some]].view(U))
        return pa.table({"group": group.view(np.int64), "node": node[some]}, schema=MEMBERS)

    return f


def check(limit: int):
    """Links of a bucket of groups (group, node, w: the check words): pairs of a group that pass the pigeonring filter and the
    Hamming check, a forest of them for the bucket."""

    def f(met: pa.Table) -> pa.Table:
        group, node = met.column("group").to_numpy(), met.column("node").to_numpy()
        words = C.joined(met.column("w"), U).reshape(len(node), CHECK)
        order = np.lexsort((node, group))
        group, node, words = group[order], node[order], words[order]
        def close(x, y):
            return near(np.repeat(words[x], len(y), axis=0), np.tile(words[y], (len(x), 1)), limit).reshape(len(x), len(y))

        pairs = links(group, lambda x, y: near(words[x], words[y], limit), close)
        names, index = np.unique(node, return_inverse=True)
        a, b = forest(len(names), *index[pairs])
        return pa.table({"a": names[a], "b": names[b]}, schema=EDGES)

    return f


def exact_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the pairs of sets (sorted, distinct) with at least the Jaccard similarity.  Such a
    pair shares one of the rarest elements of each, so only sets that meet there are compared."""
    size = np.array([len(x) for x in sets], np.int64)
    every, number, held = np.unique(np.concatenate(sets) if sets else np.zeros(0, U), return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    prefix = []
    for end, n in zip(ends.tolist(), size.tolist(), strict=True):
        e = number[end - n : end]
        prefix.append(e[np.lexsort((e, held[e]))[: n - math.ceil(similarity * n - 1e-9) + 1]])
    element = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
    order = np.argsort(element, kind="stable")
    member = np.repeat(np.arange(len(sets)), [len(x) for x in prefix])[order]
    start = np.searchsorted(element[order], np.arange(len(every) + 1))
    left, a, b = np.ones(len(sets), bool), [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            if not size[x]:
                continue
            other = np.unique(np.concatenate([member[start[e] : start[e + 1]] for e in prefix[x].tolist()]))
            other = other[left[other] & (size[other] >= similarity * size[x] - 1e-9) & (size[x] >= similarity * size[other] - 1e-9)]
            for i in range(0, len(other), BLOCK):
                y = other[i : i + BLOCK]
                hit = C.found(np.concatenate([sets[j] for j in y.tolist()]), sets[x])[0]
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[y]) - size[y])
                y = y[common * (1 + similarity) >= similarity * (size[x] + size[y]) - 1e-9].tolist()
                left[y] = False
                queue += y
                a += [x] * len(y)
                b += y
    return a, b


def confirm(shingle: int, similarity: float):
    def f(texts: pa.Table) -> pa.Table:
        words, first = C.Texts(texts.column("text")).words(lower=True)
        a, b = exact_links([shingles(words[i:j], shingle) for i, j in zip(first[:-1], first[1:], strict=True)], similarity)
        fp = texts.column("fp").to_numpy()
        return pa.table({"a": fp[a], "b": fp[b]}, schema=EDGES)

    return f


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (a 64-bit name of the signature) and component_id (the smallest doc_id that links reach, itself
    included) for each row of docs.  A null doc_id gets the component of its signature and never names one, unless it is
    alone (then null)."""
    n_chains = chains(similarity, bits)
    n_words = CHECK + math.ceil(bits * n_chains / 64)
    share = differing(similarity)
    texts = docs.selectExpr(f"cast(`{key}` AS long) AS doc_id", f"cast(`{text}` AS string) AS text")
    signed = saved(texts.mapInArrow(sign(shingle, n_words), "doc_id long, fp long, sign binary, text string"), "signatures")
    nodes = saved(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("sign").alias("sign")), "nodes")
    buckets = max(1, -(-nodes.count() * n_chains // BUCKET_ENTRIES))
    sent = nodes.select("fp", "sign").mapInArrow(send_chains(bits, n_chains, buckets), "bucket int, key binary, node binary, word binary")
    met = saved(C.decide(sent, gather(math.floor((share + WORD_SLACK) * 64)), "group long, node long"), "met")
    words = nodes.select(F.col("fp").alias("node"), F.substring("sign", 1, 8 * CHECK).alias("w"))
    buckets = max(1, -(-met.count() // BUCKET_MEMBERS))
    members = met.join(words, "node").select(F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int").alias("bucket"), "group", "node", "w")
    maybe = components(C.decide(members, check(math.floor((share + SLACK) * 64 * CHECK)), "a long, b long"))
    texts = signed.join(maybe, signed.fp == maybe.node).groupBy("component", "fp").agg(F.min("text").alias("text"))
    edges = texts.groupBy("component").applyInArrow(confirm(shingle, similarity), "a long, b long")
    edges = saved(edges, "edges")
    rows = saved(signed.select("doc_id", "fp"), "named")
    remove(signed, met)  # the texts
    return named_components(rows, nodes.select("fp", "least"), edges)
