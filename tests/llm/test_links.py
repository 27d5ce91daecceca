"""Short cuts of the near-duplicate links give the classes that all links give."""

import numpy as np
import pytest

from parlance.llm import simhash


def classes(nodes, edges):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in nodes]


def test_thin(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))] + [(5, 5), (1, 2), (1, 2)]
    thin = [tuple(r) for r in simhash.thin(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert classes(range(60), thin) == classes(range(60), edges) and all(a != b for a, b in thin)
    assert simhash.thin(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,share,bits", [(1, 0.1, 4), (2, 0.0, 4), (300, 0.03, 4), (300, 0.08, 8), (500, 0.2, 8)])
def test_forest_is_exact(n, share, bits):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, 3, dtype=np.int64).astype(np.uint64)
    noise = np.packbits(rng.random((n, 64)) < share, axis=1, bitorder="little").view("<u8")[:, 0]
    group, codes = rng.integers(0, 2, n), base[rng.integers(0, 3, n)] ^ noise
    order = np.lexsort((simhash.gray_rank(codes), group))
    group, codes = group[order], codes[order]
    label = simhash.Forest(codes, group).links(bits)
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits) & (group[:, None] == group[None, :])
    want = classes(range(n), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))])
    assert label.tolist() == want
