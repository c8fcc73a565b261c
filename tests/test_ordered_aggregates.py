"""Ordered aggregates of overlapping points against two pointers over points and buckets."""

import random

import pytest

from loomgraph.operators import metrics
from loomgraph.operators.flows import COUNTERS
from loomgraph.plans.graph import Graph, Slice


def points(spark, series):
    rows = [(str(k), v, 2 * v, 0, v // 3, s, e) for k, one in enumerate(series) for v, s, e in one]
    return spark.createDataFrame(rows, "key string, ab_packets long, ab_bytes long, ba_packets long, ba_bytes long, start long, last long")


def cut_in_two(m, cut):
    values, s, e = m
    if cut <= s:
        return None, m
    if cut >= e or s == e:
        return m, None
    early = [int(x * ((cut - s) / (e - s))) for x in values]
    return (early, s, cut), ([x - y for x, y in zip(values, early)], cut, e)


def two_pointers(series, first, last, length):
    """Both pointers only ever move on."""
    buckets = -(-(last - first) // length)
    total = {}
    for one in series:
        ms = sorted(((v, 2 * v, 0, v // 3), s, e) for v, s, e in one)
        ms.sort(key=lambda m: (m[1], m[2], m[0]))
        ms = [(list(v), s, e) for v, s, e in ms]
        i = j = 0
        while j < buckets and i < len(ms):
            lo = first + j * length
            hi = min(lo + length, last)
            _, inside = cut_in_two(ms[i], lo)
            rest = None
            if inside is not None and sum(inside[0]) == 0:
                inside = None
            elif inside is not None:
                inside, rest = cut_in_two(inside, hi)
                if inside is not None and sum(inside[0]) == 0 and lo <= ms[i][1] < hi:
                    inside, rest = ms[i], None
            if inside is None:
                j += 1
                continue
            total[j] = [a + b for a, b in zip(total.get(j, [0] * 4), inside[0])]
            if rest is not None and sum(rest[0]):
                ms[i] = rest
            else:
                i += 1
    return total


@pytest.mark.parametrize("seed", range(4))
def test_overlapping_series(spark, seed):
    rng = random.Random(seed)
    series = [[(rng.randrange(0 if seed % 2 else 1, 40), s := rng.randrange(-20, 200), s + rng.randrange(0, 60)) for _ in range(12)] for _ in range(15)]
    g = Graph(None, None, slice=Slice(0, 190, False))
    found = metrics.folded(points(spark, series), COUNTERS, 0, 190, 10, 19)
    got = {r["start"] // 10: [r[c] for c in COUNTERS] for r in found.collect()}
    assert got == two_pointers(series, 0, 190, 10) and len(got) > 5 and g is not None


def test_three_ways_to_lose_a_point(spark):
    run = lambda one: {r["start"]: r["ab_packets"] for r in metrics.folded(points(spark, [one]), COUNTERS, 0, 30, 10, 3).collect()}
    assert run([(30, 0, 30), (30, 0, 30)]) == {0: 10, 10: 10, 20: 20}  # the second one has only what is left of the last bucket
    assert run([(5, -9, -1), (5, 1, 2)]) == {}  # before the first bucket: its series ends
    assert run([(0, 1, 2), (5, 1, 2)]) == {}  # counts nothing: its series ends


def test_a_step_of_metrics(spark):
    g = Graph(None, None, slice=Slice(0, 30_000, False))
    m = metrics.Metrics(g, points(spark, [[(30, 0, 30_000), (30, 0, 30_000)]]), COUNTERS)
    assert {r["start"]: r["ab_packets"] for r in m.Aggregates(10, ordered=True).df.collect()} == {0: 10, 10_000: 10, 20_000: 20}
    assert {r["start"]: r["ab_packets"] for r in m.Aggregates(10).df.collect()} == {0: 20, 10_000: 20, 20_000: 20}
    empty = metrics.Metrics(g, points(spark, [[(1, 0, 1)]]).limit(0), COUNTERS)
    assert empty.Aggregates(10, ordered=True).df.count() == 0
