"""Near copies: no true pair is lost to a false neighbour, whatever the size of a key."""

import random

import numpy as np
import pyarrow as pa
import pytest

from arborflow.llm import near_copies as N

U = np.uint64
LIMIT = 21  # of the first word
FULL = 104  # of all eight


def flip(words, bits):
    out = np.array(words, U).copy()
    for b in bits:
        out[b // 64] ^= U(1) << U(b % 64)
    return out


def linked(signs, keys=None, full=FULL):
    """Components after the key's groups and the full check."""
    keys = np.zeros(len(signs), np.uint32) if keys is None else np.array(keys, np.uint32)
    node = np.arange(len(signs), dtype=np.int64)
    sent = pa.table({"key": [keys.tobytes()], "node": [node.tobytes()], "word": [np.ascontiguousarray(np.array(signs)[:, 0]).tobytes()]}, schema=N.SENT.remove(0))
    met = N.gather(LIMIT)(sent)
    words = [np.array(signs[i], U).tobytes() for i in met.column("node").to_pylist()]
    edges = N.check(full)(met.append_column("w", pa.array(words, pa.binary())))
    return N.reached(len(signs), edges.column("a").to_numpy(), edges.column("b").to_numpy())


@pytest.mark.parametrize("others", [0, 6, 997])
def test_a_false_neighbour_takes_no_true_pair(others):
    """A and B differ in 4 bits of the first word and few of the rest; C is near in the first word alone."""
    rng = np.random.default_rng(others)
    a = rng.integers(0, 1 << 63, N.CHECK).astype(U)
    b = flip(a, [0, 1, 2, 3, 100, 200])
    c = flip(rng.integers(0, 1 << 63, N.CHECK).astype(U), [])
    c[0] = flip(a, list(range(10, 28)))[0]
    far = [flip(rng.integers(0, 1 << 63, N.CHECK).astype(U), []) for _ in range(others)]
    for order in ([c, a, b], [a, c, b], [a, b, c]):
        top = linked([*order, *far])
        at = {id(x): i for i, x in enumerate(order)}
        assert top[at[id(a)]] == top[at[id(b)]] != top[at[id(c)]]


@pytest.mark.parametrize("others", [0, 6, 997])
def test_a_pair_at_the_limit_with_one_between(others):
    """A and B 18 bits apart in the first word, C between them at 9 and 9 but no copy."""
    rng = np.random.default_rng(others)
    a = rng.integers(0, 1 << 63, N.CHECK).astype(U)
    b = flip(a, list(range(18)))
    c = rng.integers(0, 1 << 63, N.CHECK).astype(U)
    c[0] = flip(a, list(range(9)))[0]
    far = list(rng.integers(0, 1 << 63, (others, N.CHECK)).astype(U))
    top = linked([c, a, b, *far])
    assert top[1] == top[2] != top[0]


@pytest.mark.parametrize("together", [1, 8, 10_000])
def test_components_are_those_of_all_pairs(monkeypatch, together):
    """Keys of many sizes: as all pairs that meet in a key, near in the first word, and pass the full check."""
    monkeypatch.setattr(N, "TOGETHER", together)
    r, rng = random.Random(together), np.random.default_rng(3)
    signs, keys = [], []
    for base in rng.integers(0, 1 << 63, (40, N.CHECK)).astype(U):
        for _ in range(r.choice((1, 2, 3, 9, 30))):
            signs.append(flip(base, r.sample(range(512), r.choice((0, 5, 30, 60, 110)))))
            keys.append(r.choice((0, 0, 0, 1, 2, 3)))
    got = linked(signs, keys)
    n, arr = len(signs), np.array(signs)
    links = [(i, j) for i in range(n) for j in range(i) if keys[i] == keys[j] and np.bitwise_count(arr[i, 0] ^ arr[j, 0]) <= LIMIT]
    # groups are what near first words connect; in them all pairs are checked
    group = np.arange(n)
    for _ in range(n):
        was = group.copy()
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if np.array_equal(was, group):
            break
    top = np.arange(n)
    pairs = [(i, j) for i in range(n) for j in range(i) if keys[i] == keys[j] and group[i] == group[j] and N.near(arr[i : i + 1], arr[j : j + 1], FULL)[0]]
    assert set((i, j) for i, j in links if N.near(arr[i : i + 1], arr[j : j + 1], FULL)[0]) <= set(pairs)
    for _ in range(n):
        was = top.copy()
        for i, j in pairs:
            top[i] = top[j] = min(top[i], top[j])
        if np.array_equal(was, top):
            break
    assert np.array_equal(got, top)


def shingle_sets(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()


@pytest.mark.parametrize("bits", [10, 20])
def test_recall_of_loaded_keys(spark, bits):
    """All pairs of whole documents at 0.8; with 10 bits a key holds as many of 1,000 texts as 20 bits of a million."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_sets(r.text) for r in docs.collect()}
    by = {}
    for d, s in sets.items():
        for x in s or {()}:
            by.setdefault(x, []).append(d)
    meet = {(a, b) for ds in by.values() if len(ds) < 400 for i, a in enumerate(ds) for b in ds[:i]}
    pairs = [(a, b) for a, b in meet if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    least = {d: d for d in sets}
    for _ in range(50):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.doc_id: r.component_id for r in N.near_copies(docs, bits=bits).collect()}
    wrong = [d for d in got if got[d] != least[d]]
    assert len(wrong) <= 0.01 * sum(least[d] != d for d in least) + 1 and len(pairs) > 20
