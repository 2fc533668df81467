"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from arborflow.llm.centroids import Centroids, centroid_clusters


def plain(rows, dim, k, rounds, seed, scale=1024):
    """[(key, cluster, distance)], centroids: in Python's integers, from the definition."""
    kept = [(i, x) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    whole = lambda v: math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    kept = [(i, [whole(v) for v in x]) for i, x in kept]
    centroids = [[whole(v) for v in x] for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            if own := [x for (_, x), m in zip(kept, mine) if m == j]:
                centroids[j] = [sum(v) // len(own) for v in zip(*own)]
    return [(i, *near(x)[::-1]) for i, x in kept], centroids


def check(spark, rows, dim, kind="float", **how):
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster string, x int")
    got = centroid_clusters(df.repartition(3), dim=dim, **how).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, centroids = plain(rows, dim, how.get("k", 8), how.get("rounds", 10), how.get("seed", 3))
    some = lambda n: n if n < 1 << 63 else None
    far = [sum(d for _, c, d in want if c == j) for j in range(len(centroids))]
    full = [(i, c, some(d), some(far[c]), some(sum(far)), ",".join(map(str, centroids[c]))) for i, c, d in want]
    order = lambda r: tuple((v is None, v or 0) for v in r[:3])
    assert sorted(map(tuple, got), key=order) == sorted(full, key=order)
    return got


def test_odd_vectors(spark):
    r = random.Random(1)
    x = lambda s=1.0: [r.gauss(0, s) for _ in range(6)]
    rows = [(i, x()) for i in range(300)]
    rows += [(300, None), (301, []), (302, x()[:5]), (303, [*x(), 1.0]), (304, [None, *x()[1:]]), (305, [math.nan, *x()[1:]]), (306, [math.inf, *x()[1:]]), (307, [-math.inf, *x()[1:]])]
    rows += [(None, x()), (None, x()), (5, x()), (6, rows[6][1]), (400, [0.0] * 6), (401, [-0.0] * 6), (402, [-1e-30] * 6)]
    got = check(spark, rows, 6)
    assert len(got) == 300 + 7 and not {r.vec_id for r in got} & set(range(300, 308))


@pytest.mark.parametrize("size", [2.0**13, 2.0**20, 2.0**45, 1e30])
def test_beyond_the_exact_range(spark, size):
    """Some vectors in 64-bit and in Python's integers, others in floats, and centroids between."""
    r = random.Random(2)
    rows = [(i, [r.gauss(0, size if i % 7 == 0 else 1.0) for _ in range(5)]) for i in range(120)]
    check(spark, rows, 5)
    check(spark, rows, 5, kind="double", k=3, rounds=4)


def test_largest_doubles(spark):
    check(spark, [(1, [1.7e308, 1.0]), (2, [-1.7e308, 1.0]), (3, [0.5, 2.0]), (4, [0.5, 3.0])], 2, kind="double", k=2)


def test_few_ties_and_none(spark):
    check(spark, [(i, [1.0, 1.0]) for i in range(40)], 2)  # all alike: one cluster takes all
    check(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])], 2)
    assert check(spark, [], 2) == [] and check(spark, [(1, [1.0])], 2) == []


def test_distances_are_exact_at_the_bound():
    """Integers just below and above the product's bound."""
    for top in (2**22, 2**23, 2**27, 2**40):
        x = np.array([[top - 1, top - 2, 3.0], [-(top - 1), 1.0, top - 3]]) / 1024
        model = Centroids([[top - 1, -(top - 1), 7], [-top + 5, top, -top]], 1024, np.dtype(np.float64))
        cluster, distance, q, wide = model.nearest(x.tobytes())
        for i, row in enumerate(x * 1024):
            each = [sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in model.centroids]
            assert (wide[i][0] if i in wide else distance[i]) == min(each) and cluster[i] == each.index(min(each))
