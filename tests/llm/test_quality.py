"""The additive quality model: numbers, trees, held-out accuracy and edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import quality, queries, words

DIR = "/root/testdata/sf0.01"


def numbers(*texts):
    return quality.features(*words.column_bytes(pa.array(texts, pa.string())))


def by_name(text):
    return dict(zip(quality.FEATURES, numbers(text)[0]))


def test_numbers_of_a_text():
    x = by_name("Ab ab, #1!\nAb ab.\nxyz")
    assert x["upper"] == pytest.approx(2 / 21) and x["digits"] == pytest.approx(1 / 21) and x["symbols"] == pytest.approx(1 / 21)
    assert x["log_words"] == pytest.approx(np.log1p(6)) and x["distinct_words"] == pytest.approx(5 / 6)
    assert x["capital_words"] == pytest.approx(2 / 6) and x["symbol_words"] == pytest.approx(1 / 6)
    assert x["log_lines"] == pytest.approx(np.log1p(3)) and x["words_a_line"] == 2
    assert by_name("go go go no")["repeated_next"] == pytest.approx(2 / 4)
    assert not numbers("", None).any()


def test_numbers_dont_depend_on_the_neighbours():
    texts = ["One two.", "", "ÀÉ $$$ x" * 500, None, "tail"]
    together = numbers(*texts)
    for i, text in enumerate(texts):
        assert np.allclose(numbers(text)[0], together[i])


def test_tree_is_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=9), rng.uniform(3, 5, 9)
    leaf = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality.SMOOTH)
    best = max(range(1, 9), key=lambda c: leaf(0, c) + leaf(c, 9))
    values = quality.tree(g, h, 1)
    assert len(set(values[:best])) == len(set(values[best:])) == 1 and values[0] != values[-1]


def test_quadrants_are_the_best_of_all_cuts():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=(5, 4)), rng.uniform(1, 2, (5, 4))
    leaf = lambda r, c: g[r, c].sum() ** 2 / (h[r, c].sum() + quality.SMOOTH)

    def gain(i, j):
        return sum(leaf(r, c) for r in (slice(0, i), slice(i, None)) for c in (slice(0, j), slice(j, None))) - leaf(slice(None), slice(None))

    best = max(((gain(i, j), i, j) for i in range(1, 5) for j in range(1, 4)))
    assert quality.quadrants(g, h) == pytest.approx(best)


def test_pairs_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(3)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :3] = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit(x[:3000], y[:3000])
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(500, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(int))
    for row in x[:20]:
        z = model.intercept + sum(t[sum(v >= e for e in edges)] for v, t, edges in zip(row, model.tables, model.edges))
        z += sum(t[sum(row[i] >= e for e in model.pair_edges[i]), sum(row[j] >= e for e in model.pair_edges[j])] for i, j, t in model.pairs)
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-z)))
    for edges, table, k in zip(model.edges, model.tables, range(99)):
        assert abs(table[np.searchsorted(edges, x[:, k], "right")].mean()) < 1e-9


def test_held_out_accuracy_and_good_rows_stay(spark):
    found = queries.op13_quality_classifier(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert found.count() == docs.count()
    rows = found.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert len(rows) > 50
    assert np.mean([r[0] == r[1] for r in rows]) >= 0.97 and np.mean([r[1] for r in rows if r[0] == 1]) >= 0.99


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.in_test(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, t.filter(~quality.in_test())) for t in (labels, flipped))
    assert one.intercept == two.intercept and all(np.array_equal(a, b) for a, b in zip(one.tables, two.tables))


def test_no_labels_one_class_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.5), (None, "x", 0.1), (3, None, 0.2), (4, "", 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.5] * 5
    ones = spark.createDataFrame([(1, 1), (3, 1), (None, 1), (4, None), (9, 1)], "doc_id long, quality int")
    scores = {r["score"] for r in quality.score(docs, quality.train(docs, ones)).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1
    assert quality.score(docs.limit(0), quality.Model()).count() == 0


def test_the_sample_is_bounded_by_its_parameter(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or quality.Model())
    docs = spark.createDataFrame([(i % 50, f"t {i}") for i in range(200)], "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"), sample=30)
    assert seen == [30]
