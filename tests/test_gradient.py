import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateview.operators import classify, gradient


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(4)
    words = {0: ["awful", "slow", "cold", "rude"], 1: ["okay", "average", "fine"], 2: ["great", "lovely", "tasty", "friendly"]}
    rows = []
    for i in range(90):
        label = rng.choice([0, 0, 1, 2, 2, 2])
        said = [rng.choice(words[label]) for _ in range(rng.randint(1, 4))] + [rng.choice(["food", "place", "staff", "great"]) for _ in range(3)]
        rng.shuffle(said)
        rows.append((i, " ".join(said), label))
    return spark.createDataFrame([*rows, (900, None, 1), (901, "", 2)], "review_id long, Review string, label int").cache()


@pytest.fixture(scope="module")
def fitted(reviews):
    vocabulary = gradient.numbered(reviews, "Review", "review_id", 60)
    rows = gradient.rows_of(reviews, vocabulary, "Review", ["review_id", "label"], 60)
    return rows, vocabulary


def _dense(rows, vocabulary):
    n = vocabulary.count() + 1
    x, y = np.zeros((rows.count(), n)), []
    for r, row in enumerate(rows.orderBy("review_id").collect()):
        for f in row.feats:
            x[r, f.i] = f.x
        y.append(row.label)
    return x, np.array(y)


def test_steps_equal_dense_arithmetic(fitted):
    rows, vocabulary = fitted
    x, y = _dense(rows, vocabulary)
    n, penalty = len(y), 1 / (0.5 * len(y))
    w = v = np.zeros((x.shape[1], 3))
    pull = np.full((x.shape[1], 1), penalty)
    pull[-1] = 0
    for k in range(6):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        u = v - (x.T @ (p - np.eye(3)[y]) / n + pull * v) / (1 + penalty)
        w, v = u, u + k / (k + 3) * (u - w)
    model = gradient.fit(rows, vocabulary, [0, 1, 2], 6, 0.5, 60)
    found = np.array([r.w for r in model.weights.orderBy("i").collect()])
    assert np.allclose(found, w, atol=1e-12)


def test_many_steps_reach_the_optimum_of_the_other_learner(reviews, fitted):
    """The gradient falls with the steps, to what the library's own learner leaves; both judge alike."""
    rows, vocabulary = fitted
    few, many = (gradient.fit(rows, vocabulary, [0, 1, 2], steps, 1.0, 60) for steps in (3, 40))
    assert gradient.gradient_norm(rows, many, 1.0, 60) < min(5e-3, gradient.gradient_norm(rows, few, 1.0, 60) / 10)
    other = classify.predict(classify.fit_classifier(reviews.fillna("", ["Review"]), max_features=60), reviews.fillna("", ["Review"]))
    mine = gradient.predict(rows, many, 60).select("review_id", F.col("y_pred").alias("mine"))
    both = mine.join(other, "review_id").select("mine", "y_pred").collect()
    assert sum(r.mine == r.y_pred for r in both) >= 0.97 * len(both)


def test_odd_tables(spark, fitted):
    rows, vocabulary = fitted
    model = gradient.fit(rows.limit(0), vocabulary, [0, 1, 2], 5, 1.0, 60)
    assert all(w == 0 for r in model.weights.collect() for w in r.w)
    assert {r.y_pred for r in gradient.predict(rows, model, 60).collect()} == {0}
    empty = gradient.numbered(spark.createDataFrame([(1, None)], "review_id long, Review string"), "Review", "review_id", 60)
    assert empty.count() == 0
    texts = spark.createDataFrame([(1, "great food", 7), (2, None, 8)], "review_id long, Review string, i int")
    made = gradient.rows_of(texts, empty, "Review", ["review_id", "i"], 60)
    assert [(r.review_id, r.i, [(f.i, f.x) for f in r.feats]) for r in made.orderBy("review_id").collect()] == [(1, 7, [(0, 1.0)]), (2, 8, [(0, 1.0)])]


def test_strengths_share_their_passes_and_labels_may_be_missing(spark, fitted, monkeypatch):
    """Every strength's model equals its own fit; a pass over the rows serves them all; blocks of any size give the same sums."""
    rows, vocabulary = fitted
    odd = rows.withColumn("label", F.when(F.col("review_id") % 7 == 0, None).when(F.col("review_id") % 7 == 1, 9).otherwise(F.col("label")))
    x, y = _dense(odd, vocabulary)
    known = np.array([v is not None for v in y])
    truth = np.array([[v == c for c in range(3)] for v in y], dtype=float)
    monkeypatch.setattr(gradient, "BLOCK_ENTRIES", 40)
    passes = []
    made = gradient._slopes
    monkeypatch.setattr(gradient, "_slopes", lambda *a: passes.append(1) or made(*a))
    models = gradient.fit_each(odd, vocabulary, [0, 1, 2], [0.1, 2.0], 5, 60)
    assert len(passes) == 5
    for strength, model in zip([0.1, 2.0], models):
        pull = np.full((x.shape[1], 1), 1 / (strength * len(y)))
        step = 1 / (1 + pull[0, 0])
        pull[-1] = 0
        w = v = np.zeros((x.shape[1], 3))
        for k in range(5):
            p = np.exp(x @ v)
            p /= p.sum(axis=1, keepdims=True)
            u = v - step * (x[known].T @ (p - truth)[known] / len(y) + pull * v)
            w, v = u, u + k / (k + 3) * (u - w)
        assert np.allclose(np.array([r.w for r in model.weights.orderBy("i").collect()]), w, atol=1e-12)
