"""Toxicity by nearest labelled examples under exact TF-IDF cosine, through a block-max inverted index.

Terms are all words in lower case (A-Z) and their first ``HEADS`` bytes, hashed into ``TERMS`` numbers; heads let forms of
a word meet.  Their document frequencies are counted over all documents.  The labelled rows of a bounded sample are the
examples.  A term's weight is its inverse document frequency times ``FLOOR`` plus the size of its smoothed log odds between
toxic and clean examples, so that neighbours share what tells the labels apart before they share a topic; no term's weight
is 0.

The examples' unit vectors are cut into blocks of ``BLOCK`` that resemble each other.  The most common terms have a dense
row each, so many queries meet them in one product; the others are an inverted index that holds for each term the blocks
with it and the largest value in each.  What the common terms add is a lower bound of every cosine, and with the largest
values of the rare terms an upper bound of all cosines of a block.  Blocks whose upper bound is below the k-th best lower
bound are never opened; in the others cosines are added up exactly.  So the k nearest are exact (ties: the smaller id).

Neighbours vote with their cosine squared against a prior.  A vote becomes a score by a monotone curve, fitted by pooling
adjacent violators to the votes of a fold of the labelled rows under an index without that fold.  A text without any word
has the prior as its vote; a null text has none.  Rows with a null or repeated doc_id are scored like any other; a label
counts for all rows of its doc_id, and examples with equal texts count once.  Extra columns are left aside.  Long texts are
read whole, a slice of rows at a time; one text's terms are held at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tables import saved

U = np.uint64
#: Most labelled rows in the sample that learning sees, in the order of a hash of their id; numbers for terms; heads.
SAMPLE, TERMS, HEADS = 2_500, 1 << 18, (4, 6)
#: Examples that a term's log odds are smoothed by, and the least factor of a term.
SMOOTH, FLOOR = 10.0, 0.05
#: Examples of a block; a term of more than this share of the examples has a dense row, DENSE at most; queries that meet
#: these at once; clusters that order the examples.
BLOCK, COMMON, DENSE, TOGETHER, CLUSTERS = 16, 1 / 128, 2048, 128, 16
K, PRIOR_WEIGHT = 15, 2.0
#: Labelled rows whose id's hash has this remainder fit the curve; examples that a step of the curve is smoothed by.
FOLD, PULL = (5, 0), 2.0
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("vote", pa.float64()), ("neighbours", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])


def term_counts(texts: C.Texts, n_terms: int = TERMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term number, count), in order of document and term."""
    reader, docs, hashes = C._Eights(texts.data, True), [], []
    for s, e in texts.spans():
        d = np.searchsorted(texts.offsets, s, side="right") - 1
        hashes.append(reader.hashes(s, e))
        docs.append(d)
        for size in HEADS:
            long = np.flatnonzero(e - s >= size)
            hashes.append(C.mix(reader.hashes(s[long], s[long] + size) + U(size)))
            docs.append(d[long])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(docs) * n_terms + (np.concatenate(hashes) % U(n_terms)).astype(np.int64)
    key.sort()
    at = C.groups(key)
    n = np.diff(np.append(at, len(key)))
    return key[at] // n_terms, key[at] % n_terms, n


def frequencies(batches):
    total, rows = np.zeros(TERMS, np.int64), 0
    for batch in C.portions(batches):
        total += np.bincount(term_counts(C.Texts(batch.column("text")))[1], minlength=TERMS)
        rows += batch.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], names=["term", "n"])


def ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places a[i] to b[i], end to end, and i for each."""
    n = b - a
    some = np.flatnonzero(n)
    a, n = a[some], n[some]
    ends = np.cumsum(n)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        out[0] = a[0]
        out[ends[:-1]] = a[1:] - a[:-1] - n[:-1] + 1
    return np.cumsum(out, out=out), np.repeat(some, n)


def alike(term: np.ndarray, value: np.ndarray, row: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """A cluster for each of n vectors, by a few rounds of k-means over the most common terms."""
    often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:DENSE]
    at = np.full(n_terms, -1)
    at[often] = np.arange(len(often))
    some = at[term] >= 0
    x = np.zeros((n, DENSE))
    x[row[some], at[term[some]]] = value[some]
    centre, own = x[:: max(1, n // CLUSTERS)][:CLUSTERS], np.zeros(n, np.int64)
    for _ in range(5 if n else 0):
        own = (x @ centre.T - (centre * centre).sum(axis=1) / 2).argmax(axis=1)
        centre = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centre)])
    return own


class Index:
    """A block-max inverted index of unit vectors, and their labels."""

    def __init__(self, idf: np.ndarray, vectors: list, k: int = K):
        """vectors: (example id, terms, counts, label); terms in rising order."""
        self.k, n_terms = k, len(idf)
        labels = np.array([v[3] for v in vectors], np.float64)
        base = (labels.sum() + 1) / (len(labels) + 2)
        zero = [v[3] for v in vectors if not len(v[1])]
        #: Vote of a document without neighbours: the share of toxic ones among such examples.
        self.prior = (sum(zero) + base) / (len(zero) + 1)
        full = [v for v in vectors if len(v[1])]
        y = np.array([v[3] for v in full], np.float64)
        term = np.concatenate([v[1] for v in full]).astype(np.int32) if full else np.zeros(0, np.int32)
        size = np.array([len(v[1]) for v in full], np.int64)
        row = np.repeat(np.arange(len(full)), size)
        held, toxic = np.bincount(term, minlength=n_terms), np.bincount(term, weights=y[row], minlength=n_terms)
        odds = np.log((toxic + SMOOTH * base) / (held - toxic + SMOOTH * (1 - base))) - np.log(base / (1 - base))
        self.weight = idf * (FLOOR + np.abs(odds))
        count = np.concatenate([v[2] for v in full]) if full else np.zeros(0, np.int64)
        value = (1 + np.log(count)) * self.weight[term]
        value = value / np.sqrt(np.bincount(row, weights=value * value, minlength=len(full)))[row]
        order = np.lexsort((np.arange(len(full)), -y, alike(term, value, row, len(full), n_terms)))  # side by side
        begin = np.cumsum(size) - size
        place = np.repeat(begin[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(term))
        self.ids, self.y = np.array([v[0] for v in full], np.int64)[order], y[order]
        self.term, self.value = term[place], value[place]
        self.start = np.concatenate([[0], np.cumsum(size[order])])
        self._fill()

    def _fill(self) -> None:
        """What follows from the vectors and does not travel: dense rows of the common terms, and the block-max lists."""
        n_terms, n = len(self.weight), len(self.ids)
        self.blocks = -(-n // BLOCK)
        row = np.repeat(np.arange(n), np.diff(self.start))
        held = np.bincount(self.term, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:DENSE]
        often = often[held[often] > COMMON * n]
        self.at = np.full(n_terms, -1, np.int32)
        self.at[often] = np.arange(len(often))
        common = self.at[self.term] >= 0
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        self.dense[self.at[self.term[common]], row[common]] = self.value[common]
        rare = np.flatnonzero(~common)
        key = self.term[rare].astype(np.int64) * max(1, self.blocks) + row[rare] // BLOCK
        order = np.argsort(key, kind="stable")
        self.row, self.part = row[rare][order], self.value[rare][order]
        at = C.groups(key[order])
        #: For each (term, block) with the term: its postings, their largest value, and the block.
        self.posts = np.append(at, len(order))
        self.most = np.maximum.reduceat(self.part, at) if len(at) else np.zeros(0)
        key = key[order][at]
        self.block = key % max(1, self.blocks)
        self.lists = np.searchsorted(key // max(1, self.blocks), np.arange(n_terms + 1))
        self.opened = self.asked = 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("k", "prior", "weight", "ids", "y", "term", "value", "start", "curve")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fill()

    def weigh(self, t: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[t]
        return w / np.sqrt((w * w).sum())

    def common(self, queries: list) -> np.ndarray:
        """What the common terms add to the cosines of (terms, weights), for every example."""
        q = np.zeros((len(queries), len(self.dense)))
        for i, (t, w) in enumerate(queries):
            at = self.at[t]
            q[i, at[at >= 0]] = w[at >= 0]
        return q @ self.dense

    def nearest(self, t: np.ndarray, w: np.ndarray, cos: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a cosine above 0, nearest first; cos: see common."""
        cos = self.common([(t, w)])[0] if cos is None else cos
        if not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        rare = self.at[t] < 0
        place, of = ranges(self.lists[t[rare]], self.lists[t[rare] + 1])
        weight = w[rare][of]
        # no cosine in a block is above its largest so far and the largest of each rare term
        bound = cos.reshape(-1, BLOCK).max(axis=1) + np.bincount(self.block[place], weights=self.most[place] * weight, minlength=self.blocks)
        # nothing is negative, so the k-th best cosine is at least the k-th best so far
        least = np.partition(cos, -self.k)[-self.k] if len(cos) >= self.k else 0.0
        open_ = bound >= least - 1e-9
        go = open_[self.block[place]]
        post, of = ranges(self.posts[place[go]], self.posts[place[go] + 1])
        cos = cos + np.bincount(self.row[post], weights=self.part[post] * weight[go][of], minlength=len(cos))
        self.opened, self.asked = self.opened + int(open_.sum()), self.asked + self.blocks
        at = np.flatnonzero((cos > 0) & np.repeat(open_, BLOCK))
        if len(at) > self.k:
            at = at[cos[at] >= np.partition(cos[at], -self.k)[-self.k] - 1e-12]
        at = at[np.lexsort((self.ids[at], -np.round(cos[at], 12)))[: self.k]]
        return at, cos[at]

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        v = cos * cos
        return float((v @ self.y[at] + PRIOR_WEIGHT * self.prior) / (v.sum() + PRIOR_WEIGHT))

    def votes(self, texts: C.Texts):
        """(vote, ids of the neighbours, cosines) for each text."""
        out = [(self.prior, [], [])] * len(texts)
        d, t, c = term_counts(texts, len(self.weight))
        rows = [(d[i], t[i:j], self.weigh(t[i:j], c[i:j])) for i, j in C.runs(d)]
        for k in range(0, len(rows), TOGETHER):
            part = rows[k : k + TOGETHER]
            for (i, x, w), common in zip(part, self.common([r[1:] for r in part]), strict=True):
                at, cos = self.nearest(x, w, common)
                out[i] = (self.vote(at, cos), self.ids[at].tolist(), cos.tolist())
        return out


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, scores) of a rising curve, to be joined by straight lines: pools of adjacent violators at their mean vote,
    each pulled to the overall share by PULL examples."""
    if not len(votes):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(votes, kind="stable")
    share = labels.mean()
    pools: list[list[float]] = []  # votes, labels, n
    for v, i, j in ((votes[order][a], a, b) for a, b in C.runs(votes[order])):
        pools.append([v * (j - i), float(labels[order][i:j].sum()), j - i])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x = np.array([p[0] / p[2] for p in pools])
    y = np.maximum.accumulate([(p[1] + PULL * share) / (p[2] + PULL) for p in pools])
    return x, y


def score_all(index: Index):
    def f(batches):
        for batch in C.portions(batches):
            votes, near, cosines = zip(*index.votes(C.Texts(batch.column("text"))), strict=True)
            scores = np.interp(votes, *index.curve)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(votes), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], schema=OUT)

    return f


def vote_all(index: Index):
    def f(batches):
        for batch in C.portions(batches):
            votes = [v for v, _, _ in index.votes(C.Texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(votes)], names=["doc_id", "toxic", "vote"])

    return f


def vectors(batches):
    for batch in C.portions(batches):
        n = batch.num_rows
        d, t, c = term_counts(C.Texts(batch.column("text")))
        at = np.searchsorted(d, np.arange(n + 1))
        blobs = [pa.array([x[i:j].astype(np.int32).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (t, c)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("apart"), *blobs], names=["doc_id", "toxic", "apart", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = K) -> Index:
    """The index, from rows of labels (doc_id, toxic) that docs has; a doc_id with several labels counts as toxic if
    one of them says so, and texts that are equal count once."""
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    few = marked.orderBy(F.xxhash64("_id", F.lit(4)), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(few), F.expr("doc_id = _id")).select("doc_id", "text", "toxic")  # bounded by sample
    first = rows.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("doc_id").alias("_id")).select("_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLD[0])) == FOLD[1]
    rows = saved(rows.join(F.broadcast(first), F.expr("doc_id = _id")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold.alias("apart")), "sample")
    # a row a term number
    found = texts.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    held = np.zeros(TERMS)
    held[term[term >= 0]] = n[term >= 0]
    idf = np.log((1 + n[term < 0].sum()) / (1 + held)) + 1
    # the sample bounds what is collected
    got = rows.mapInArrow(vectors, "doc_id long, toxic int, apart boolean, terms binary, counts binary").toArrow().sort_by("doc_id")
    arrays = lambda x: [np.frombuffer(b.as_buffer(), np.int32) for b in got.column(x)]
    examples = list(zip(got.column("doc_id").to_pylist(), arrays("terms"), arrays("counts"), got.column("toxic").to_pylist(), strict=True))
    index = Index(idf, examples, k)
    rest = Index(idf, [x for x, a in zip(examples, got.column("apart").to_pylist(), strict=True) if not a], k)
    # the sample bounds these too
    held = rows.where("apart").mapInArrow(vote_all(rest), "doc_id long, toxic int, vote double").toArrow().sort_by("doc_id")
    index.curve = fit_curve(held.column("vote").to_numpy(), held.column("toxic").to_numpy().astype(float))
    return index


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = K) -> DataFrame:
    """doc_id, score (0 to 1), vote, and the neighbours (ids) and cosines that it rests on, for each row of docs.  An empty
    table gives no rows; without labels the score is 0.5 throughout."""
    index = fit(docs, labels, sample, k)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score_all(index), "doc_id long, score double, vote double, neighbours array<long>, cosines array<double>")
