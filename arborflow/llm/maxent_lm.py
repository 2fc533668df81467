"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Words (lower-case A-Z) and one end a text are tokens.  A token's class is the band of its rank by count in the training
texts (class 0: not seen, class 1: seen once), each band of twice as many words as those before it, and its slot a hash
within the class.  The model is
P(token) = P(class | context) * P(slot | class, context) * count / (counts of the slot), the first two factors
softmaxes over hashed features of the words before: bias, the last word, the last two, and skips over one or two words.
A word seen once at most is the same unknown word in a context.
While it trains, a token counts as seen once less than it was, so single occurrences teach what unseen words look like.

Counts cover all training texts and reach the documents through hash buckets.  Training takes ``STEPS`` synchronous
gradient steps.  Step t reads the training texts whose id hashes to t, so each text is used once; all tasks sum the
gradient (expected less observed outcomes of each feature) at the same weights, the sums are added in a tree of bounded
fan-in, and the weights move by the gradient over the outcomes expected of the feature.  So the model follows from the data
alone, whatever the tasks.  A step has no more tasks than its texts are times as large as the model: gradients take no
more bytes than the input.  Scoring is batched over tokens in numpy.
The model grows with the input: classes with the logarithm of the vocabulary, so that a band's words do not depend on
the size of the counts, and hashed rows of each factor with the square root of the tokens (2**16 at 0.5 GB).

A null or empty text has one token, its end.  Words are told apart by 64-bit hashes.  Rows with equal doc_id are texts of
their own; a null doc_id is one more id.  A batch holds the hashes of its tokens, so a very long text takes memory in
proportion to its number of tokens, in its own batch.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tables import saved

U = np.uint64
#: Slots of a class, words of the first band, and fewest hashed rows.
SLOTS, FIRST_BAND, LEAST_ROWS = 16, 16, 4096
#: Bins of counts, BIN_STEPS for each doubling, from which ranks are read.
BINS, BIN_STEPS = 512, 8
#: Stand for the place before a text and for a word seen once at most.
START, UNKNOWN = np.uint32(0), np.uint32(1)
#: Gradient steps, their rate, what is added to expected outcomes, least tokens taken together, cuts of a gradient, and gradients
#: added in one task.
STEPS, RATE, PRIOR, CHUNK, SLICES, FAN = 8, 0.5, 20.0, 1 << 15, 16, 16
END = U(0xE0D0E0D0E0D0E0D1)
SENT = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])
COUNTED = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("c", pa.binary()), ("mass", pa.list_(pa.float64()))])
CODED_DDL = "share int, doc_id array<long>, train binary, n binary, known binary, base binary, inner binary, number binary, word binary, leaf binary, less binary"
CODED = pa.schema([("share", pa.int32()), ("doc_id", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("train", "n", "known", "base", "inner", "number", "word", "leaf", "less"))])
SUMS = pa.schema([("slice", pa.int32()), ("branch", pa.int32()), ("g", pa.binary())])
SUMS_DDL = "slice int, branch int, g binary"
OUT = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


class Shape(NamedTuple):
    """The class of each bin of counts, and the model's numbers of classes and rows."""

    bands: np.ndarray
    classes: int
    rows: int

    def factors(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Views of the weights: rows by classes, rows by slots."""
        cut = self.rows * self.classes
        return weights[:cut].reshape(self.rows, self.classes), weights[cut:].reshape(self.rows, SLOTS)


def bin_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(counts, 1)) * BIN_STEPS + 1e-9), BINS - 1).astype(np.int64)


def shape_of(words: np.ndarray, n: float) -> Shape:
    """words: training words by bin of their count; n: training tokens.  A bin's rank is that of its last word."""
    rank = np.cumsum(words[::-1])[::-1]
    bands = 2 + np.ceil(np.log2(np.maximum(rank, FIRST_BAND) / FIRST_BAND)).astype(np.int64)
    bands[0] = 1
    return Shape(bands, int(bands[1:].max()) + 1, max(LEAST_ROWS, 1 << round(math.log2(max(n, 2)) / 2 + 3)))


def class_of(counts: np.ndarray, bands: np.ndarray) -> np.ndarray:
    return np.where(counts <= 0, 0, bands[bin_of(counts)])


def tokens(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and index of each document's first one."""
    words, first = C.Texts(docs.column("text")).words(lower=True)
    out = np.insert(words, first[1:], END)
    return out, first + np.arange(len(first))


def _unique(docs: pa.Table, buckets: int):
    """Distinct tokens of a batch by bucket and hash, and the number of each token in that order."""
    h, first = tokens(docs)
    key, inverse = np.unique(h, return_inverse=True)
    bucket = (key >> U(40)) % U(buckets)
    order = np.lexsort((key, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return key[order], bucket[order], rank[inverse], first


def send_counts(buckets: int):
    def f(docs: pa.Table) -> pa.Table:
        key, bucket, number, first = _unique(docs, buckets)
        train = docs.column("train").to_numpy().astype(bool)
        counts = np.bincount(number[np.repeat(train, np.diff(first))], minlength=len(key)).astype(np.uint32)
        rows = {x: [] for x in SENT.names}
        for b, i, j in C.buckets_of(bucket):
            for x, v in zip(SENT.names, (docs.column("batch")[0].as_py(), b, key[i:j].tobytes(), counts[i:j].tobytes()), strict=True):
                rows[x].append(v)
        return C.table_of(SENT, rows)

    return f


def add_counts(sent: pa.Table) -> pa.Table:
    """Total counts for each batch in the order it asked, and a row with the counts of the bucket by bin and slot
    (and, behind them, its distinct tokens by bin)."""
    n = C.sizes(sent.column("h"), 8)
    h, c = C.joined(sent.column("h"), U), C.joined(sent.column("c"), np.uint32).astype(np.int64)
    order = np.argsort(h, kind="stable")
    at = C.groups(h[order])
    total = np.add.reduceat(c[order], at)
    each = np.empty_like(c)
    each[order] = np.repeat(total, np.diff(np.append(at, len(h))))
    bins, ok = bin_of(total), total > 0
    mass = np.bincount(bins * SLOTS + slot_of(h[order][at]), weights=total, minlength=BINS * SLOTS)
    words = np.bincount(bins[ok], minlength=BINS)
    rows = {x: [] for x in COUNTED.names}
    for batch, bucket, i, m in zip(sent.column("batch").to_pylist(), sent.column("bucket").to_pylist(), np.cumsum(n) - n, n, strict=True):
        for x, v in zip(COUNTED.names, (batch, bucket, each[i : i + m].tobytes(), None), strict=True):
            rows[x].append(v)
    for x, v in zip(COUNTED.names, (-1, sent.column("bucket")[0].as_py(), None, [*mass.tolist(), *words.astype(float).tolist()]), strict=True):
        rows[x].append(v)
    return C.table_of(COUNTED, rows)


def slot_of(h: np.ndarray) -> np.ndarray:
    return (C.mix(h) % U(SLOTS)).astype(np.int64)


def leaf_of(h: np.ndarray, counts: np.ndarray, bands: np.ndarray) -> np.ndarray:
    k = class_of(counts, bands)
    return np.where(k == 0, 0, k * SLOTS + slot_of(h)).astype(np.uint16)


def word_of(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A token in a context: 32 bits of its hash."""
    return np.where(counts > 1, np.maximum(C.mix(h) >> U(32), U(2)), U(UNKNOWN)).astype(np.uint32)


def code(buckets: int, bands: np.ndarray):
    def f(docs: pa.Table, counted: pa.Table) -> pa.Table:
        key, bucket, number, first = _unique(docs, buckets)
        by = np.argsort(counted.column("bucket").to_numpy(), kind="stable")
        blobs = counted.column("c").combine_chunks()
        c = np.concatenate([np.frombuffer(blobs[int(i)].as_buffer(), np.int64) for i in by])
        assert len(c) == len(key), "the answers do not fit the batch"
        train = docs.column("train").to_numpy().astype(bool)
        n, starts = np.diff(first), first[:-1]
        total = lambda v: np.add.reduceat(v[number], starts)  # noqa: E731  a document has a token at least
        word, leaf, less = word_of(key, c), leaf_of(key, c, bands), leaf_of(key, c - 1, bands)
        rows = {"n": n, "known": total((c > 0).astype(np.int64)), "base": total(np.log10(c + 1.0)), "inner": total(np.log10(np.maximum(c, 1)))}
        out = {x: [] for x in CODED.names}
        share, doc_id = share_of(C.ids(docs)), docs.column("doc_id").combine_chunks()
        for t in range(STEPS):
            docs_of = np.flatnonzero(share == t)
            for i, j in _spans(n[docs_of], 1 << 17):
                mine = docs_of[i:j]
                place = _places(starts[mine], n[mine])
                used, at = np.unique(number[place], return_inverse=True)  # each token of the span once, and numbers into them
                row = {"share": t, "doc_id": doc_id.take(pa.array(mine)).to_pylist(), "train": train[mine].tobytes(), "number": at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes()}
                row |= {"word": word[used].tobytes(), "leaf": leaf[used].tobytes(), "less": less[used].tobytes()}
                row |= {k: v[mine].astype(np.float64 if k in ("base", "inner") else np.int64).tobytes() for k, v in rows.items()}
                for x in CODED.names:
                    out[x].append(row[x])
        return C.table_of(CODED, out)

    return f


def share_of(ids: np.ndarray) -> np.ndarray:
    """The step that a document's id falls to."""
    return (C.mix(ids.astype(np.int64).view(U)) % U(STEPS)).astype(np.int64)


def _places(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + n[i], end to end."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _spans(n: np.ndarray, most: int):
    """(from, to) of documents with about most tokens together."""
    at, ends = 0, np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def contexts(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The last three words before each token, START before a text's first: shape (3, tokens)."""
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((3, len(word)), START, np.uint32)
    for k in (1, 2, 3):
        out[k - 1, k:] = word[:-k] if len(word) > k else word[: len(word) - k]
        out[k - 1, place < k] = START
    return out


def features(ctx: np.ndarray, kind: np.ndarray | int, shape: Shape) -> np.ndarray:
    """Rows of the weights for each token, shape (tokens, features); kind is 0, or 1 + the token's class."""
    p1, p2, p3 = ctx
    kind = np.atleast_1d(np.asarray(kind, np.uint32))
    salt = np.uint32(0x9E3779B1) * (kind + np.uint32(1))
    own = np.uint32(shape.classes + 1)  # the bias has a row of its own for each kind
    out = [np.broadcast_to(kind, p1.shape)]
    zero = np.zeros(1, np.uint32)
    for k, (a, b) in enumerate(((p1, zero), (p1, p2), (p2, zero), (p1, p3))):
        h = (salt + np.uint32(k + 1)) * np.uint32(0x85EBCA6B) + a * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(np.broadcast_to(own + (h ^ (h >> np.uint32(13))) % (np.uint32(shape.rows) - own), p1.shape))
    return np.stack(out, axis=1).astype(np.int64)


def softmax_parts(w: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the features' weights less their largest, their exponentials, and the sums of these."""
    z = w.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += w.take(rows[:, k], axis=0)
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return z, e, e.sum(axis=1)


def log_chance(w: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log of the probability of outcomes y."""
    z, _, total = softmax_parts(w, rows)
    return z[np.arange(len(y)), y].astype(np.float64) - np.log(total.astype(np.float64))


def add_gradient(grad: np.ndarray, w: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
    """Adds expected less observed outcomes of each feature to grad (a line for each outcome, and one that counts the
    feature's tokens).  The bias, each token's first feature, has few rows."""
    _, e, total = softmax_parts(w, rows)
    p = np.ascontiguousarray((e / total[:, None]).T, np.float64)
    p[y, np.arange(len(y))] -= 1
    others = rows[:, 1:].T.ravel()
    for line, x in zip(grad, [*p, np.ones(len(y))], strict=True):
        line += np.bincount(others, weights=np.tile(x, rows.shape[1] - 1), minlength=len(line))
        bias = np.bincount(rows[:, 0], weights=x)
        line[: len(bias)] += bias


def moved(w: np.ndarray, grad: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights after a step: against the gradient, over the outcomes that a feature's tokens have on average (share) or
    the observed surplus, if that is larger; so no weight moves by more than about RATE."""
    g, n = grad[:-1].T, grad[-1:].T
    return w - RATE * g / (n * share + np.maximum(-g, 0) + PRIOR)


def coded(batch):
    """Rows of a batch of the coded table, as arrays."""
    for r in range(batch.num_rows):
        get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
        word = get("word", np.uint32)
        at = get("number", np.uint16 if len(word) <= 1 << 16 else np.uint32)
        per_doc = (get(c, t) for c, t in (("n", np.int64), ("known", np.int64), ("base", np.float64), ("inner", np.float64)))
        yield batch.column("doc_id")[r].values, get("train", bool), *per_doc, word[at], get("leaf", np.uint16)[at], get("less", np.uint16)[at]


def gradient(weights: np.ndarray, shape: Shape):
    """The gradient of a task's training texts at the weights, in SLICES cuts."""

    def f(batches):
        from pyspark import TaskContext

        w = shape.factors(weights)
        grads = [np.zeros((x.shape[1] + 1, shape.rows)) for x in w]
        size = max(CHUNK, shape.rows // 2)
        seen = False
        for batch in batches:
            for _, train, n, _, _, _, word, _, less in coded(batch):
                at = np.flatnonzero(np.repeat(train, n))
                ctx, y = contexts(word, n)[:, at], less[at].astype(np.int64)
                seen |= len(at) > 0
                for i in range(0, len(at), size):
                    x, k = ctx[:, i : i + size], y[i : i + size] // SLOTS
                    add_gradient(grads[0], w[0], features(x, 0, shape), k)
                    known = np.flatnonzero(k)
                    if len(known):
                        add_gradient(grads[1], w[1], features(x[:, known], k[known] + 1, shape), y[i : i + size][known] % SLOTS)
        if seen:
            cuts = np.concatenate([g.ravel() for g in grads]).astype(np.float32).reshape(SLICES, -1)
            pid = TaskContext.get().partitionId()
            for i, cut in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pid], pa.int32()), pa.array([cut.tobytes()], pa.binary())], schema=SUMS)

    return f


def add_up(key: tuple, rows: pa.Table) -> pa.Table:
    total = None
    for x in rows.column("g"):
        v = np.frombuffer(x.as_buffer(), np.float32)
        total = v.astype(np.float64) if total is None else total + v
    return pa.table([[key[0].as_py()], [key[1].as_py()], [total.astype(np.float32).tobytes()]], schema=SUMS)


def summed(sums: DataFrame, n_tasks: int) -> DataFrame:
    """A row a slice: sums of the tasks' cuts, FAN of them in a task at a time."""
    while n_tasks > 1:
        sums = sums.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).groupBy("slice", "branch").applyInArrow(add_up, SUMS_DDL)
        n_tasks = -(-n_tasks // FAN)
    return sums


def start_weights(mass: np.ndarray, shape: Shape) -> np.ndarray:
    """Weights without context: biases from the counts by class and slot.  Class 0 starts with what single occurrences
    take."""
    weights = np.zeros(shape.rows * (shape.classes + SLOTS), np.float32)
    w0, w1 = shape.factors(weights)
    some = lambda x: x + np.where(x > 0, 0.5, 1e-9)  # noqa: E731  nothing worth mentioning where there are no words
    share = some(mass.sum(axis=1))
    share[0] = mass[1].sum() + 0.5
    w0[0] = np.log(share / share.sum())
    leaf = some(mass)
    w1[1 : shape.classes + 1] = np.log(leaf / leaf.sum(axis=1, keepdims=True))
    return weights


def train(coded_docs: DataFrame, n_bytes: int, mass: np.ndarray, shape: Shape) -> np.ndarray:
    """The weights after STEPS steps over the coded texts of n_bytes: the driver receives a gradient, of the model's size,
    for each."""
    weights = start_weights(mass, shape)
    kinds, slots = mass.sum(axis=1) + 0.5, mass.sum(axis=0) + 0.5
    kinds[0] = mass[1].sum() + 0.5
    shares = kinds / kinds.sum(), slots / slots.sum()
    n_tasks = max(1, n_bytes // (STEPS * weights.nbytes))
    for t in range(STEPS):
        part = coded_docs.where(F.col("share") == t).drop("share").coalesce(n_tasks)
        got = {r.slice: np.frombuffer(r.g, np.float32) for r in summed(part.mapInArrow(gradient(weights, shape), SUMS_DDL), n_tasks).collect()}  # SLICES rows
        if got:
            flat, cut = np.concatenate([got[i] for i in range(SLICES)]).astype(np.float64), shape.rows * (shape.classes + 1)
            grads = flat[:cut].reshape(-1, shape.rows), flat[cut:].reshape(-1, shape.rows)
            weights = np.concatenate([moved(w, g, s).ravel() for w, g, s in zip(shape.factors(weights), grads, shares, strict=True)]).astype(np.float32)
    return weights


def score_all(weights: np.ndarray, shape: Shape, log_mass: np.ndarray):
    def f(batches):
        w0, w1 = shape.factors(weights)
        for batch in batches:
            for doc_ids, train_, n, known, base, inner, word, leaf, _ in coded(batch):
                p = np.zeros(len(leaf))
                ctx = contexts(word, n)
                for i in range(0, len(leaf), CHUNK):
                    x, t = ctx[:, i : i + CHUNK], leaf[i : i + CHUNK].astype(np.int64)
                    k = t // SLOTS
                    out = log_chance(w0, features(x, 0, shape), k)
                    seen = np.flatnonzero(k)
                    if len(seen):
                        out[seen] += log_chance(w1, features(x[:, seen], k[seen] + 1, shape), t[seen] % SLOTS)
                    p[i : i + CHUNK] = out / np.log(10) - np.where(k > 0, log_mass[t], 0.0)
                score = np.add.reduceat(p, np.cumsum(n) - n) + inner
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(train_), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], schema=OUT)

    return f


def maxent_scores(docs: DataFrame, train_rows, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10) for each row of
    docs; train_rows is the condition of the rows to learn from (null: not)."""
    marked = docs.withColumn("train", F.coalesce(train_rows, F.lit(False)))
    plan = C.Plan(marked, text, key, keep=("train",))
    buckets = plan.buckets(1 / 20)
    sent = plan.emit(send_counts(buckets), "batch int, bucket int, h binary, c binary")
    counted = saved(C.decide(sent, add_counts, "batch int, bucket int, c binary, mass array<double>"), "counts")
    sums = {r.i: r.x for r in counted.where("batch = -1").select(F.posexplode("mass").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).where("x <> 0").collect()}  # a row a bin and slot
    by_bin = np.array([sums.get(i, 0.0) for i in range(BINS * SLOTS)]).reshape(BINS, SLOTS)
    words = np.array([sums.get(BINS * SLOTS + i, 0.0) for i in range(BINS)])
    n, v = float(by_bin.sum()), float(words.sum())
    shape = shape_of(words, n)
    mass = np.zeros((shape.classes, SLOTS))
    np.add.at(mass, shape.bands, by_bin)
    coded_docs = saved(plan.answer(counted.where("batch >= 0").select("batch", "bucket", "c"), code(buckets, shape.bands), CODED_DDL), "coded", by="share")
    weights = train(coded_docs, plan.bytes, mass, shape)
    log_mass = np.log10(np.maximum(mass.ravel(), 1.0))
    out = coded_docs.drop("share").mapInArrow(score_all(weights, shape, log_mass), "doc_id long, train boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(n + v + 1))
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
