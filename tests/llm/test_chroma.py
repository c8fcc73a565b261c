"""op6 against plain Python: the integers from loops over whole numbers, the groups from all pairs and offsets."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chroma, queries

DIR = "/root/testdata/sf0.001"


def plain_fingerprint(samples):
    """Recordings of fewer than 1,664 samples are repeated."""
    samples = [samples[k % len(samples)] for k in range(max(1664, len(samples)))] if samples else samples
    table = chroma.TABLES.astype(int).tolist()
    energy = []
    for at in range(0, len(samples) - chroma.FRAME + 1, chroma.HOP):
        found = [sum((samples[at + t] - 128) * table[t][k] for t in range(chroma.FRAME)) for k in range(72)]
        e = [float(found[k]) * found[k] + float(found[k + 36]) * found[k + 36] for k in range(36)]
        energy.append([e[c] + e[c + 12] + e[c + 24] for c in range(12)])
    image = []
    for i in range(len(energy) - 4):
        row = [0.0] * 12
        for k, w in enumerate(chroma.SMOOTH):
            row = [r + x * w for r, x in zip(row, energy[i + k])]
        total = 0.0
        for r in row:
            total += r
        image.append([round(r / (total if total > 0 else 1.0) * chroma.SCALE) for r in row])
    out = []
    for i in range(len(image) - chroma.WIDTH + 1):
        bits = 0
        for (kind, low, height, width), levels in zip(chroma.FILTERS, chroma.THRESHOLDS):
            a = b = 1
            for t in range(width):
                for c in range(height):
                    late, high = t >= width // 2, c >= height // 2
                    side = {0: True, 1: high, 2: late, 3: late != high, 4: height // 3 <= c < 2 * (height // 3), 5: width // 3 <= t < 2 * (width // 3)}[kind]
                    if side:
                        a += image[i + t][low + c]
                    else:
                        b += image[i + t][low + c]
            bits = bits << 2 | (0, 1, 3, 2)[sum(a > b * x for x in levels)]
        out.append(bits - (1 << 32) * (bits >> 31))
    return out


def plain_groups(rows):
    """(doc_id, items) to sorted (doc_id, n_items, group_id, recordings)."""
    of = {}
    for d, items in rows:
        of.setdefault(tuple(items), []).append(d)
    names = [k for k in of if k]
    up = {k: k for k in names}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for x, a in enumerate(names):
        for b in names[:x]:
            for shift, n in Counter(q - p for p, u in enumerate(a) for q, v in enumerate(b) if u == v).items():
                over = [(p, p + shift) for p in range(len(a)) if 0 <= p + shift < len(b)]
                wrong = sum(((a[p] ^ b[q]) & 0xFFFFFFFF).bit_count() for p, q in over)
                if n >= chroma.VOTES and len(over) * 2 >= min(len(a), len(b)) and wrong <= chroma.ERRORS * len(over):
                    up[find(a)] = find(b)
    whole = {}
    for k in names:
        whole.setdefault(find(k), []).extend(of[k])
    out = [(d, 0, d, 1) for d in of.get((), [])]
    for k in names:
        ids = whole[find(k)]
        out += [(d, len(k), min((i for i in ids if i is not None), default=None), len(ids)) for d in of[k]]
    return sorted(map(str, out))


def check_alignments(got, recordings):
    """Each alignment is a match of two recordings of a group, at the best of all offsets with votes enough; all recordings with others have one."""
    items = {}
    for d, s in recordings:
        items.setdefault(d, []).append(chroma.fingerprint(np.frombuffer(s or b"", np.uint8)).tolist())
    group = {(r["doc_id"], r["n_items"]): r["group_id"] for r in got}
    for r in got:
        if r["recordings"] == 1 or r["aligned_with"] is None:
            assert r["aligned_with"] is r["shift"] is r["overlap"] is r["bit_errors"] is None
            assert r["recordings"] == 1
            continue
        seen = set()
        for a in (x for x in items[r["doc_id"]] if len(x) == r["n_items"]):
            for b in items[r["aligned_with"]]:
                fit = []
                for shift, n in Counter(q - p for p, u in enumerate(a) for q, v in enumerate(b) if u == v).items():
                    over = [(p, p + shift) for p in range(len(a)) if 0 <= p + shift < len(b)]
                    bits = sum(((a[p] ^ b[q]) & 0xFFFFFFFF).bit_count() for p, q in over)
                    if n >= chroma.VOTES and len(over) * 2 >= min(len(a), len(b)) and bits <= chroma.ERRORS * len(over):
                        fit.append((bits / len(over), -len(over), abs(shift), shift, bits))
                if fit:
                    least = min(fit)[:3]
                    seen |= {(x[3], -x[1], x[4]) for x in fit if x[:3] == least}
        assert (r["shift"], r["overlap"], r["bit_errors"]) in seen
        assert r["group_id"] in {g for (d, _), g in group.items() if d == r["aligned_with"]}


def melody(rng, seconds):
    t = np.arange(2000)
    return np.concatenate([np.rint(128 + 90 * np.sin(2 * math.pi * t * rng.uniform(440, 3000) / chroma.RATE)) for _ in range(seconds * 4)]).astype(np.uint8)


@pytest.fixture(scope="module")
def recordings():
    rng, noise = random.Random(6), np.random.default_rng(6)
    songs = [melody(rng, 2) for _ in range(4)]
    rows, short = [(i, s.tobytes()) for i, s in enumerate(songs)], songs[3][:1280].tobytes()
    rows += [(10 + i, np.clip(s + noise.integers(-3, 4, len(s)), 0, 255).astype(np.uint8).tobytes()) for i, s in enumerate(songs)]  # near copies
    rows += [(20, songs[0][64 * 40 :].tobytes()), (21, songs[1][: 64 * 150].tobytes()), (22, np.concatenate([songs[2], songs[3]]).tobytes())]  # parts and joins
    rows += [(30 + i, np.clip(songs[0] + noise.integers(-2, 3, len(songs[0])), 0, 255).astype(np.uint8).tobytes()) for i in range(12)]  # one large group
    return rows + [(50, rows[0][1]), (50, rows[1][1]), (None, rows[1][1]), (None, noise.bytes(9000)), (51, None), (52, b""), (53, noise.bytes(1471)), (54, noise.bytes(1472)), (55, bytes(3000)), (56, bytes(6000)), *((k, short) for k in (60, 61, 61, None)), (62, b"a"), (63, b"a"), (64, b"abc")]


def test_integers():
    rng = np.random.default_rng(1)
    texts = ["some words of a text that is long enough, or so " * 40]
    for s in (rng.bytes(1471), rng.bytes(1472), rng.bytes(2100), bytes(1600), texts[0].encode(), melody(random.Random(2), 1).tobytes()[:3000]):
        assert chroma.fingerprint(np.frombuffer(s, np.uint8)).tolist() == plain_fingerprint(s)
    for n in (1, 2, 50, 256, 1663, 1664):
        s = rng.bytes(n)
        assert chroma.fingerprint(np.frombuffer(s, np.uint8)).tolist() == plain_fingerprint(s) and len(plain_fingerprint(s)) == chroma.VOTES
    assert plain_fingerprint(b"") == chroma.fingerprint(np.zeros(0, np.uint8)).tolist() == []


@pytest.mark.parametrize("block", [2, chroma.BLOCK])
def test_groups_of_recordings(spark, recordings, block):
    frame = spark.createDataFrame(recordings, "doc_id long, samples binary")
    expected = plain_groups([(d, chroma.fingerprint(np.frombuffer(s or b"", np.uint8)).tolist()) for d, s in recordings])
    got = chroma.groups(frame, block).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == expected
    check_alignments(got, recordings)
    assert {(r["group_id"], r["recordings"]) for r in got if r["doc_id"] in (60, 61)} == {(60, 4)} and any(r["shift"] not in (None, 0) and r["bit_errors"] for r in got)
    sizes = Counter(x.split(", ", 2)[2] for x in expected)
    assert max(sizes.values()) >= 14 and len(sizes) > 4


def test_pairs_that_no_star_proposes(spark):
    """b and c match, but a third recording is first, and a fourth last, in all of the values that they share."""
    rng = random.Random(3)
    shared_, other = [rng.randrange(1 << 31) for _ in range(8)], lambda n: [rng.randrange(1 << 31) for _ in range(n)]
    known = {1: [v for x in shared_ for v in (x, *other(5))], 2: shared_ + other(1), 3: shared_ + other(1), 4: [v for x in shared_ for v in (x, *other(9))]}
    posts = spark.createDataFrame([(v, k, p, 1, k) for k, items in known.items() for p, v in enumerate(items)], "value int, print long, pos int, length int, root long")
    frame = spark.createDataFrame(list(known.items()), "print long, items array<int>")
    assert chroma.confirmed(chroma.stars(posts), frame).collect() == []
    for block in (1, 3, 1000):
        assert [tuple(r) for r in chroma.confirmed(chroma.crossing(posts, block), frame).collect()] == [(2, 3, 0, 9, sum((x ^ y).bit_count() for x, y in zip(known[2], known[3])))]


def test_op6(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op6_chroma_fingerprints"](spark, DIR).collect()
    check_alignments(found, [(d, (t or "").encode()) for d, t in rows])
    assert all(r["n_items"] >= chroma.VOTES for r in found if dict(rows)[r["doc_id"]])
    got = sorted(str(tuple(r)[:4]) for r in found)
    assert got == plain_groups([(d, chroma.fingerprint(np.frombuffer((t or "").encode(), np.uint8)).tolist()) for d, t in rows])
    assert len(got) == len(rows) and any(not x.endswith(" 1)") for x in got)


def test_runs_vote_as_their_integers_do(spark):
    rng = random.Random(9)
    known = {k: [rng.randrange(4) for _ in range(rng.randrange(1, 5)) for _ in [0] * rng.randrange(1, 3)] + [k % 3] * rng.randrange(9) + [3, 3] for k in range(1, 9)}
    frame = spark.createDataFrame(list(known.items()), "print long, items array<int>")
    posts = chroma.runs(frame).withColumn("root", F.col("print"))
    known = {k: v for k, v in known.items() if len(v) >= chroma.VOTES}
    expected = {(a, b, s) for a in known for b in known if a < b for s, n in Counter(q - p for p, u in enumerate(known[a]) for q, v in enumerate(known[b]) if u == v).items() if n >= chroma.VOTES}
    for block in (2, 1000):
        assert {tuple(r) for r in chroma.crossing(posts, block).collect()} == expected and expected


def test_frequent_values_make_no_rows_of_pairs(spark):
    """Many recordings share four integers that their first and last ones have elsewhere; those that match are found whether their values are joined as rows or compared in tasks."""
    rng = random.Random(12)
    other = lambda n: [rng.randrange(1 << 31) for _ in range(n)]
    known = {k: other(3 + k % 3) + [7, 7, 8, 7, 9] + other(9) for k in range(2, 300)} | {1: [v for x in (7, 8, 9) for v in (x, *other(9))], 300: [v for x in (7, 8, 9) for v in (x, *other(8))]}
    for k in range(10, 20):  # near copies of others, some of them shifted
        known[k + 100] = known[k][k % 2 :] + other(k % 2)
        known[k + 100][5] ^= 3 if k % 3 else 0
    frame = spark.createDataFrame(list(known.items()), "print long, items array<int>")
    posts = chroma.common(chroma.runs(frame)).withColumn("root", F.col("print"))
    voted = {(a, b): chroma.best(*(np.array(known[k], np.int32) for k in (a, b)), chroma.voted(*(np.array(known[k], np.int32) for k in (a, b)))) for a in known for b in known if a < b}
    expected = {(*k, *v) for k, v in voted.items() if v}
    assert len(expected) >= 10
    for few, tile in ((32, 250), (2, 3), (0, 50)):
        rows = chroma.crossing(posts.filter(F.col("n") <= few))
        found = chroma.confirmed(rows, frame).unionByName(chroma.frequent(posts.filter(F.col("n") > few), frame, tile))
        assert {tuple(r) for r in found.collect()} == expected
    # 300 recordings, 45,000 pairs of them
    assert chroma.crossing(posts.filter(F.col("n") <= chroma.FEW)).count() < 300


def test_all_offsets_of_a_match():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 3, rng.integers(1, 40)).astype(np.int32), rng.integers(0, 3, rng.integers(1, 40)).astype(np.int32)
        votes = Counter(q - p for p, u in enumerate(a.tolist()) for q, v in enumerate(b.tolist()) if u == v)
        assert chroma.voted(a, b) == sorted(s for s, n in votes.items() if n >= chroma.VOTES)


def test_stars_count_an_integer_once(spark):
    """Two recordings that are first and last in the values they share meet in three integers, which isn't enough."""
    known = {1: [11, 12, 13, 14, 15, 16], 2: [11, 12, 13, 14 ^ 1, 15 ^ 64, 16 ^ 32], 3: [31, 32, 33, 34, 35, 36], 4: [31, 32, 33, 34, 35 ^ 64, 36 ^ 64]}
    frame = spark.createDataFrame(list(known.items()), "print long, items array<int>")
    assert [tuple(r) for r in chroma.stars(chroma.runs(frame)).collect()] == [(3, 4, 0)]
