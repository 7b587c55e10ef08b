"""Components of graphs with a very large star, with and without minima as tables."""

import random

import pytest

from kinstats.llm.components import components


@pytest.mark.parametrize("large", [0, 10_000_000])
def test_components_equal_those_by_force(spark, large):
    rng = random.Random(6)
    links = [(7, k) for k in range(100, 5_000)] + [(k, k + 1) for k in range(6_000, 6_040)] + [(rng.randrange(8_000, 8_300), rng.randrange(8_000, 8_300)) for _ in range(150)]
    links += [(4_999, 6_020), (3, 3), (9_001, 9_000), (9_000, 9_001)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"), large=large).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), large=large).count() == 0
