"""What a batch sends to the ranges of the filters."""

import numpy as np
import pytest

from arborflow.llm import line_dedup as L


@pytest.mark.parametrize("n", [0, 1, 7, 2047, 2048, 2049, 50_000])
def test_bits_come_back(n):
    rng = np.random.default_rng(n)
    bits = np.unique(rng.integers(0, L.RANGE_BITS, n)).astype(np.uint32)
    blob = L.sparse(bits)
    assert np.array_equal(L.unsparse(blob), bits) and len(blob) <= 4 + 4 * n


def test_bytes_do_not_grow_with_ranges():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 40, 20_000)
    def sent(ranges):
        return sum(len(L.sparse(np.unique(digests[digests % ranges == r] // ranges % L.RANGE_BITS).astype(np.uint32))) for r in range(ranges))

    assert sent(10_000) < 1.6 * sent(10) + 4 * 10_000
