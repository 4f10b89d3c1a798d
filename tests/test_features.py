import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plateview.operators import classify, features
from plateview.sources.models import load_model, save_model

TEXTS = ["Great food, great staff!", "slow staff and slow service", "the food was okay", "Café food a b", "great great great"]


def grams(text):
    tokens = re.findall(r"\b\w\w+\b", text.lower())
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")


def test_vocabulary_and_weights_against_brute_force(texts):
    tf = Counter(g for t in TEXTS for g in grams(t))
    df = Counter(g for t in TEXTS for g in set(grams(t)))
    vocab = features.vocabulary(texts, "id", "t")
    assert {r["term"]: (r["tf"], r["df"]) for r in vocab.collect()} == {g: (tf[g], df[g]) for g in tf}
    got = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(texts, "id", "t", features.with_idf(vocab, texts)).collect()}
    expected = {}
    for i, text in enumerate(TEXTS):
        raw = {g: n * (math.log((1 + len(TEXTS)) / (1 + df[g])) + 1) for g, n in Counter(grams(text)).items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        expected.update({(i, g): pytest.approx(x / length) for g, x in raw.items()})
    assert got == expected


def test_top_terms_break_ties_by_term(texts):
    assert [r["term"] for r in features.vocabulary(texts, "id", "t", 3).orderBy(F.col("tf").desc(), "term").collect()] == ["great", "food", "great great"]


@pytest.fixture(scope="module")
def ratings(spark):
    kinds = [("5", "lovely great food number {}"), ("1", "awful slow service number {}"), ("3", "okay average place number {}")]
    rows = [(i, kinds[i % 3][1].format(i), kinds[i % 3][0]) for i in range(90)]
    return spark.createDataFrame(rows, "review_id long, Review string, Rating string")


def test_train_evaluate_save_and_load(spark, ratings, tmp_path):
    result = classify.train_and_evaluate(ratings, 0.25, max_iter=30)
    assert {r["split"]: r["n"] for r in result["sizes"].collect()} == {"train": 67, "test": 23}
    assert result["headline"].first()["accuracy"] == 1.0
    assert {r["class"] for r in result["report"].collect()} == {"Negative", "Neutral", "Positive", "accuracy", "macro avg", "weighted avg"}
    path = str(tmp_path / "deep" / "model")
    save_model(result["model"], path)
    texts = ratings.select("review_id", "Review")
    before, after = (classify.predict(m, texts).orderBy("review_id").collect() for m in (result["model"], load_model(path)))
    assert before == after and set(before[0].asDict()) == {"review_id", "Review", "y_pred"}


def test_classifier_minimises_the_summed_loss_with_unit_penalty(spark, ratings):
    train = ratings.withColumn("label", F.when(F.col("Rating") == "5", 2).when(F.col("Rating") == "1", 0).otherwise(1)).limit(45)
    model = classify.fit_classifier(train, max_iter=500)
    rows = model.transform(train).select("label", "_features").collect()
    x = np.array([r["_features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    learned = model.stages[-1]
    weights, intercept = learned.coefficientMatrix.toArray(), learned.interceptVector.toArray()
    z = x @ weights.T + intercept
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ x + weights  # of the summed loss plus half the squared norm
    assert np.abs(gradient).max() < 0.02
    assert np.linalg.norm(x, axis=1) == pytest.approx(np.ones(len(x)))


def test_sweep_fits_one_learner_per_strength(ratings):
    labelled = ratings.withColumn("label", F.when(F.col("Rating") == "5", 2).when(F.col("Rating") == "1", 0).otherwise(1))
    tried = classify.sweep(labelled.filter("review_id < 60"), labelled.filter("review_id >= 60"), [0.5, 2.0], max_iter=30).collect()
    assert [r["strength"] for r in tried] == [0.5, 2.0] and all(r["accuracy"] == 1.0 for r in tried)


def test_report_keeps_the_order_of_labels(spark):
    from plateview.operators import metrics
    counts = spark.createDataFrame([(2, 2, 3), (0, 1, 1), (1, 1, 2)], "y_true int, y_pred int, n long")
    rows = metrics.report(counts, [0, 1, 2], {0: "Z", 1: "Y", 2: "X"}).orderBy("ord").collect()
    assert [r["class"] for r in rows] == ["Z", "Y", "X", "accuracy", "macro avg", "weighted avg"]


def test_sweep_takes_the_best_macro_f1(spark):
    tried = spark.createDataFrame([(0.3, 0.8, 0.5, 0.7), (1.0, 0.7, 0.6, 0.7), (3.0, 0.9, 0.6, 0.9)],
                                  "strength double, accuracy double, macro_f1 double, weighted_f1 double")
    assert classify.best_by_macro_f1(tried).first()["strength"] == 1.0


def test_counts_told_in_parts_and_sparse_rows(spark, texts, monkeypatch):
    """Terms that a task tells several times add up; a row's weights are those of ``tfidf``, numbered in the order of the terms."""
    odd = texts.unionByName(spark.createDataFrame([(7, None), (8, "?"), (8, "GREAT great-food"), (9, "\u00c9clair caf\u00e9\ttable_1")], "id long, t string")).coalesce(1)
    whole = {tuple(r) for r in features.vocabulary(odd, "id", "t").collect()}
    count = features._partial_counts
    passed = list(count(iter([pa.record_batch({"_said": ["great food great", None, "", "great food"]})])))
    assert {tuple(r.values()) for b in passed for r in b.to_pylist()} == {("great", 3, 2), ("food", 2, 2), ("great food", 2, 2), ("food great", 1, 1)}
    monkeypatch.setattr(features, "HELD_TERMS", 2)
    assert len(list(count(iter([pa.record_batch({"_said": ["great food", "slow food"]})])))) > 1
    tf = Counter(g for r in odd.collect() if r.t for g in grams(r.t))
    df = Counter(g for r in odd.collect() if r.t for g in set(grams(r.t)))
    assert whole == {(g, tf[g], df[g]) for g in tf}
    vocab = features.with_idf(features.vocabulary(odd, "id", "t", 6), odd).orderBy("term").collect()
    numbered = spark.createDataFrame([(i, r["term"], r["idf"]) for i, r in enumerate(vocab)], "i int, term string, idf double")
    found = {(r.id, vocab[f.i]["term"]): f.x for r in features.sparse_rows(texts, ["id"], "t", numbered).collect() for f in r.feats}
    wanted = {(r.id, r.term): r.weight for r in features.tfidf(texts, "id", "t", numbered).collect()}
    assert found == {k: pytest.approx(v, abs=1e-12) for k, v in wanted.items()} and wanted
    empty = {r.id: r.feats for r in features.sparse_rows(odd, ["id"], "t", numbered).collect()}
    assert empty[7] == []
