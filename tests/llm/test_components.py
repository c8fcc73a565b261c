"""Connected components of random, long and star-shaped graphs."""

import random

import pytest

from loomgraph.llm import components


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(i, i + 1) for i in range(70)],
        "star": [(0, i) for i in range(1, 200)] + [(500, i) for i in range(400, 499)],
        "none": [],
        "loops": [(3, 3), (4, 4), (4, 5), (5, 4)],
    }[kind]
    got = components.connected(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == brute(pairs)
