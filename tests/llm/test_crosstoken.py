"""The lockstep merging of two tokenizers' tokens against token by token."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import crosstoken, words
from tests.llm import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["hello", "  ", " ", "\n", "\n\n", "\t", "é", "ß", "▁", "<s>", "<|endoftext|>", "日本", "😀", "word", "don't", "1234", "a b", "　", "...", ",", "the", "ﬁ", "\x00", " x", " "]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", None, " ", "a" * 3000, "日本語" * 300, "the same words " * 60]


def summary(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, crosstoken.summary(docs, A, B).collect()), key=str)


def test_equals_token_by_token(spark):
    found = texts(1)
    expected = brute.aligned(found)
    got = {r[0]: r[1:] for r in summary(spark, list(enumerate(found)))}
    assert len(got) == len(found)
    for i, e in enumerate(expected):
        assert got[i][:6] == e[:6]
        assert e[6] is None or got[i][6] == e[6]
    assert sum(e[0] > 0 for e in expected) > 200 and sum(e[0] == 0 for e in expected) > 20


def test_long_texts_are_several_lanes(monkeypatch):
    """Lanes of any length give the same links, groups and hashes."""
    tools = crosstoken.Two(A, B)
    rng = random.Random(4)
    array = pa.array([" ".join(rng.choice(["stone", "münze", "Σοφία", "x1y2", "日本語", "zz-top"]) for _ in range(3000)), "short", None, "日" * 2000])
    one = {}
    for size in (7, 256, 10**9):
        real = crosstoken.lanes
        monkeypatch.setattr(crosstoken, "lanes", lambda *x, size=size: real(*x, size=size))
        one[size] = crosstoken.align(tools, *words.column_bytes(array))
        monkeypatch.setattr(crosstoken, "lanes", real)
    for size in (7, 256):
        for key in one[size]:
            assert np.array_equal(np.asarray(one[size][key]), np.asarray(one[10**9][key])), key


def test_lockstep_steps_are_few():
    ends = np.arange(1, 100_001)
    from_a, to_a, from_b, to_b = crosstoken.lanes(ends, ends, np.array([0, 100_000]), np.array([0, 100_000]))
    assert (to_a - from_a).max() <= crosstoken.LANE + 1 and (to_a - from_a).sum() == 100_000


@pytest.mark.parametrize("batch", [200, 1 << 20])
def test_counts_are_of_the_corpus_however_it_is_cut(spark, monkeypatch, batch):
    monkeypatch.setattr(crosstoken, "BATCH", batch)
    rows = list(enumerate(texts(2, 60)))
    expected = brute.aligned([t for _, t in rows])
    got = {r[0]: r[1:7] for r in summary(spark, rows)}
    assert [got[i] for i in range(len(rows))] == [e[:6] for e in expected]


def test_empty_table_repeated_rows_null_ids_and_other_columns(spark):
    assert summary(spark, []) == []
    rows = [(1, "one two"), (1, "one two"), (None, "one"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pair": F.lit("x"), "batch": F.lit(1), "docs": F.lit(2)})
    got = sorted(map(tuple, crosstoken.summary(docs, A, B).collect()), key=str)
    expected = brute.aligned([t for _, t in rows])
    assert got == sorted([(i, *e) for (i, _), e in zip(rows, expected)], key=str)
