"""Small buckets, like large ones, are compared by planes."""

import numpy as np
import pytest

from attestor.llm import simhash


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_many_small_buckets(radius):
    r = np.random.default_rng(4)
    buckets = []
    for n in [*range(1, 33), *([2] * 200)]:
        fps = r.integers(0, 1 << 63, n).astype(np.uint64)
        for k in range(1, n):
            if r.random() < 0.5:
                fps[k] = fps[k - 1]
                for bit in r.integers(0, 64, r.integers(0, 4)):
                    fps[k] ^= np.uint64(1) << np.uint64(bit)
        buckets.append(fps)
    want = {(b, i, j) for b, f in enumerate(buckets) for i in range(len(f)) for j in range(i + 1, len(f)) if int(f[i] ^ f[j]).bit_count() <= radius}
    for at_once in (64, 1000, 1 << 16):
        got = [(b, i, int(j)) for b, found in simhash.within_each(buckets, radius, at_once).items() for i, js in found for j in js]
        assert len(got) == len(want) and set(got) == want
