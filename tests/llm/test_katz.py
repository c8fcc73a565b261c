"""op5: a bucket adds up the probabilities of the next lower order by itself, except those of split words."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import katz, shared
from tests.llm import brute


def batches(rng):
    for _ in range(2):
        count = np.array([rng.randrange(1, 30) for _ in range(40)], np.uint32)
        tokens = np.array([min(rng.randrange(20), rng.randrange(20)) for _ in range(int(count.sum()))], np.uint32)
        flags = np.array([2 * (rng.random() < 0.2) for _ in count], np.uint8)
        yield katz.Batch({"count": count, "flags": flags, "tokens": tokens, "word_ids": np.arange(20, dtype=np.uint64) * np.uint64(7) + np.uint64(3)})


def test_lower_probabilities_are_not_sent():
    rng = random.Random(5)
    both = list(batches(rng))
    turing, empty = katz.GoodTuring([30, 12, 7, 4, 3, 2]), katz.Hot([])
    none = (empty, np.zeros((0, katz.K + 1), np.int64), np.zeros(0))

    def order(k, lower, below, split):
        step = katz.Order(k, 6, empty, split, 1e9, below)
        rows = [r for n, (b, p) in enumerate(zip(both, lower)) for r in step.ask(n, b, p)]
        told = [x for bucket in range(6) if any(r[2] == bucket for r in rows) for x in step.tell(bucket, [r for r in rows if r[2] == bucket])]
        out = [step.learn(b, [x for x in told if x[0] == katz._GRAMS and x[1] == n], p, turing, none) for n, (b, p) in enumerate(zip(both, lower))]
        return out, sum(len(r[7]) for r in rows)

    # split words: the most frequent one, and the start
    split = katz.Hot([((3,), 3), ((int(katz.START),), 2)])
    for words in (empty, split):
        p, _ = order(2, [np.full(len(b.tokens), 0.05) for b in both], None, empty)
        for k in (3, 4):
            sent, size = order(k, p, None, words)
            own, small = order(k, p, turing, words)
            assert all(np.array_equal(x, y) for x, y in zip(sent, own))
            assert small < size * (0.4 if words is empty else 0.95), (k, small, size)
            p = own


def test_training_tokens_need_no_lower_order():
    """An order can be had at some tokens only, and its next lower one is needed where they aren't in training."""
    rng = random.Random(6)
    both = list(batches(rng))
    turing, empty = katz.GoodTuring([30, 12, 7, 4, 3, 2]), katz.Hot([])
    none = (empty, np.zeros((0, katz.K + 1), np.int64), np.zeros(0))
    step = katz.Order(2, 6, empty, empty, 1e9)
    lower = [np.full(len(b.tokens), 0.05) for b in both]
    rows = [r for n, b in enumerate(both) for r in step.ask(n, b, lower[n])]
    told = [x for bucket in range(6) for x in step.tell(bucket, [r for r in rows if r[2] == bucket])]
    for n, b in enumerate(both):
        replies = [x for x in told if x[0] == katz._GRAMS and x[1] == n]
        every = step.learn(b, replies, lower[n], turing, none)
        held = np.flatnonzero(~b.train)
        assert len(held) and (every > 0).all()
        assert np.array_equal(step.learn(b, replies, lower[n][held], turing, none, held), every[held])
        assert np.array_equal(step.learn(b, replies, np.where(b.train, np.nan, 0.05), turing, none), every)


def test_unigrams_are_told_by_word():
    """Bigrams are asked with the counts of their distinct words in place of a probability each; what comes of it is the same."""
    rng = random.Random(8)
    both = list(batches(rng))
    turing, empty = katz.GoodTuring([30, 12, 7, 4, 3, 2]), katz.Hot([])
    none = (empty, np.zeros((0, katz.K + 1), np.int64), np.zeros(0))
    total = sum(np.bincount(b.tokens[b.train], minlength=20) for b in both)
    unigrams = katz.Unigrams(int(total.sum()), int((total > 0).sum()), katz._histogram(total).tolist())
    lower = []
    for b in both:
        b.word_counts = total
        lower.append(unigrams.p(total)[b.tokens])

    def order(*told_by):
        step = katz.Order(2, 6, empty, empty, 1e9, None, *told_by)
        rows = [r for n, b in enumerate(both) for r in step.ask(n, b, None if told_by else lower[n])]
        told = [x for bucket in range(6) for x in step.tell(bucket, [r for r in rows if r[2] == bucket])]
        p = [step.learn(b, [x for x in told if x[0] == katz._GRAMS and x[1] == n], lower[n], turing, none) for n, b in enumerate(both)]
        return p, sum(len(r[7]) for r in rows)

    sent, size = order()
    own, small = order(unigrams)
    assert all(np.array_equal(x, y) for x, y in zip(sent, own))
    assert small < size * 0.6, (small, size)


def test_numbers_survive_packing():
    for values in ([], [0], [255, 256, 0], [2**64 - 1, 3], list(range(300))):
        x = np.array(values, np.uint64)
        assert np.array_equal(katz.unpack(katz.pack(x), "u8"), x)
    for x in (np.array([-1, 5, 2**40]), np.array([0.0, -0.5, 1e-300]), np.array([0, 3], np.uint8)):
        assert np.array_equal(katz.unpack(katz.pack(x), x.dtype), x)
    assert len(katz.pack(np.arange(250, dtype=np.uint64))) < 300  # one byte each; bytes that are 0 everywhere aren't kept
    rng = random.Random(7)
    for top in (3, 1 << 20, 1 << 63):  # the last doesn't fit into a word with its place
        x = np.array([rng.randrange(top) for _ in range(500)] + [top - 1], np.uint64)
        first, number = katz._distinct(x)
        uniq, at, inverse = np.unique(x, return_index=True, return_inverse=True)
        assert np.array_equal(first, at) and np.array_equal(number, inverse) and np.array_equal(x[first], uniq)


def test_an_order_is_evaluated_once(spark):
    """What the batches made of an order is kept as P of the tokens that back off: its replies are gone, and the score reads those of the last order."""
    rows = [(i, " ".join(random.Random(i % 17).choices("a b c d e f g h".split(), k=12))) for i in range(60)]
    top = Path(shared.work_dir(spark).removeprefix("file://"))
    before = set(top.iterdir())
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = katz.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), held, order=4, batch_bytes=200)
    made = set(top.iterdir()) - before
    assert sum(p.name.startswith("katz-grams") for p in made) == 3
    assert sum((p / f"kind={katz._GRAMS}").exists() for p in made) == 1
    expected, _ = brute.katz(rows, 4)
    got = scored.collect()
    assert len(got) == 60 and all(abs(r["score"] - expected[r["doc_id"]][5]) < 1e-9 * max(1, -r["score"]) for r in got)
