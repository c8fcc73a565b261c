"""Spelling variants against all pairs of words."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import spelling
from tests.llm import brute

SCHEMA = "doc_id long, text string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def found(spark, rows):
    out = spelling.variants(spelling.vocabulary(spark.createDataFrame(rows, SCHEMA)))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def texts(seed, n=120):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéß") for _ in range(rng.randint(4, 7))) for _ in range(25)]
    return [(i, " ".join(rng.choice(stems).capitalize() if rng.random() < 0.2 else rng.choice(stems) for _ in range(40))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs_of_words(spark, seed):
    rows = texts(seed) + [(500, None), (501, ""), (None, "Straße Straße Straße strasse"), (3, "x" * 100_000)]
    rows += rows[:7] + [(600 + i, t) for i, t in enumerate(["cable " * 20, "cables " * 8, "cabless " * 3])]  # repeated rows count each
    expected = sorted(brute.spelling(rows), key=str)
    assert found(spark, rows) == expected
    assert any(r[1] for r in expected) and any(r[1] != r[2] for r in expected if r[1])  # forms, and chains of them


def test_every_kind_of_edit_at_every_place_is_found(spark):
    base = "tessellate"
    words = {base} | {base[:i] + base[i + 1 :] for i in range(10)} | {base[:i] + c + base[i:] for i in range(11) for c in "aé"} | {base[:i] + c + base[i + 1 :] for i in range(10) for c in "tzé"}
    got = {(r["a"], r["b"]) for r in spelling.near(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    expected = {p for a, b in combinations(words, 2) if brute.one_edit(a, b) for p in ((a, b), (b, a))}
    assert got == expected


@pytest.mark.parametrize("parts", [(3, 2), (5, 3), (7, 4)])
def test_any_number_of_partitions_gives_the_same_pairs(spark, parts):
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(150)}
    got = {(r["a"], r["b"]) for r in spelling.near(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), *parts).collect()}
    assert got == {p for a, b in combinations(words, 2) if brute.one_edit(a, b) for p in ((a, b), (b, a))}


def test_anagrams_share_no_signature_without_an_equal_half(spark):
    rows = spelling.signatures(spark.createDataFrame([("abcdefgh", 3), ("hgfedcba", 3)], "word string, n long"))
    assert rows.groupBy("sig", "role").count().filter("count > 1").count() == 0


def test_ties_take_the_smallest_form(spark):
    rows = [(i, t) for i, t in enumerate(["betas bytas batas"] * 8 + ["botas"] * 3)]
    got = {r[0]: r for r in found(spark, rows)}
    assert sorted(got.values(), key=str) == sorted(brute.spelling(rows), key=str)


def test_empty_and_other_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame(texts(5, 20), SCHEMA).withColumns({"word": F.lit("clash"), "n": F.lit(1), "_id": F.lit(2), "sig": F.lit(3)})
    expected = sorted(brute.spelling(texts(5, 20)), key=str)
    assert sorted(map(tuple, spelling.variants(spelling.vocabulary(docs)).collect()), key=str) == expected
