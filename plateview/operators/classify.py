"""Review-level sentiment classifier: TF-IDF and multinomial logistic regression."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from plateview.functions.text import WORD
from plateview.operators import features, metrics, splits
from plateview.operators.ratings import clean_ratings
from plateview.schemas import BLOCK_BYTES, LABEL_NAMES, MAX_FEATURES, MAX_ITERATIONS, SPLIT_SEED, TEST_SHARE
from plateview.sources.scratch import measured_bytes, stored

FEATURE_COLUMNS = ["_tokens", "_bigrams", "_terms", "_counts", "_weighted", "_features"]


def feature_stages(vocab_idf: DataFrame, n_rows: int, text: str) -> list:
    """Fitted stages from text to unit-length TF-IDF vectors.

    The vocabulary is the caller's top-k; all of it, and nothing else, reaches the driver.
    """
    fitted = vocab_idf.select("term", "df").orderBy("term").collect()
    idf = [math.log((1.0 + n_rows) / (1.0 + row["df"])) + 1.0 for row in fitted]
    pattern = WORD.replace("\\", "\\\\")
    return [
        SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower({text}), '{pattern}', 0) AS _tokens FROM __THIS__"),
        NGram(n=2, inputCol="_tokens", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(_tokens, _bigrams) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary([row["term"] for row in fitted], inputCol="_terms", outputCol="_counts"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_weighted"),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="_features"),
    ]


def fit_stages(train: DataFrame, text: str = "Review", id_col: str = "review_id", max_features: int = MAX_FEATURES) -> list:
    """``feature_stages`` fitted on the training rows alone."""
    fitted = stored(features.vocabulary(train, id_col, text, max_features), "vocabulary")
    return feature_stages(fitted, train.count(), text)


def vectors_of(stages: list, rows: DataFrame, label: str = "label") -> DataFrame:
    """``(label, _features)``, stored, so that no iteration of a fit makes them again."""
    made = PipelineModel(stages).transform(rows).select(F.col(label).cast("double").alias("label"), "_features")
    return stored(made, "features")


def fit_learner(vectors: DataFrame, max_iter: int = MAX_ITERATIONS, strength: float = 1.0):
    """Multinomial logistic regression on stored vectors.

    ``strength`` is the inverse weight of the penalty against the *sum* of losses; Spark minimises their mean.
    The tolerance leaves a largest gradient entry below 1e-4 of the mean loss on texts of this kind. Partitions hold
    ``BLOCK_BYTES`` of the stored vectors, for every iteration is a job with a task per partition.
    """
    learner = LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial", maxIter=max_iter, tol=1e-6,
                                 regParam=1.0 / (strength * vectors.count()), elasticNetParam=0.0, standardization=False,
                                 predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw")
    return learner.fit(vectors.coalesce(max(1, measured_bytes(vectors) // BLOCK_BYTES)))


def fit_classifier(train: DataFrame, text: str = "Review", label: str = "label", id_col: str = "review_id",
                   max_features: int = MAX_FEATURES, max_iter: int = MAX_ITERATIONS, strength: float = 1.0) -> PipelineModel:
    """Features and classifier fitted on the training rows alone, as one model."""
    stages = fit_stages(train, text, id_col, max_features)
    return PipelineModel([*stages, fit_learner(vectors_of(stages, train, label), max_iter, strength)])


def predict(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """Adds ``y_pred``; the working columns of the model are dropped."""
    return (model.transform(texts).withColumn("y_pred", F.col("_prediction").cast("int"))
            .drop(*FEATURE_COLUMNS, "_prediction", "_probability", "_raw"))


def evaluate(predictions: DataFrame, truth: str = "label", predicted: str = "y_pred") -> dict[str, DataFrame]:
    """Report and matrix over all three classes; headline F1 over the classes that occur."""
    counts = stored(metrics.pair_counts(predictions, truth, predicted), "pairs")
    return {
        "report": metrics.report(counts, metrics.ALL_LABELS, LABEL_NAMES),
        "confusion": metrics.confusion(counts, metrics.ALL_LABELS),
        "headline": metrics.headline(counts),
    }


def split_ratings(raw: DataFrame, test_size: float = TEST_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Cleaned ratings, stored once because many passes follow, with their ``split``."""
    clean = stored(clean_ratings(raw), "ratings")
    divided = stored(splits.split_two_way(clean, "review_id", "label", test_size, seed), "split")
    splits.assert_no_leak(divided, "Review", ["train", "test"])
    return divided


def report_on(divided: DataFrame, model: PipelineModel) -> dict[str, DataFrame]:
    """``report``, ``confusion``, ``headline`` of a model on the test rows of a split, and the ``sizes`` of its parts."""
    return {**evaluate(predict(model, divided.filter(F.col("split") == "test"))), "sizes": splits.split_sizes(divided)}


def _trained(raw: DataFrame, test_size: float, fitting: dict) -> tuple[PipelineModel, DataFrame]:
    divided = split_ratings(raw, test_size)
    return fit_classifier(divided.filter(F.col("split") == "train"), **fitting), divided


def evaluation_report(raw: DataFrame, test_size: float = TEST_SHARE, **fitting) -> dict[str, DataFrame]:
    """From raw ratings to the tables of ``report_on``."""
    model, divided = _trained(raw, test_size, fitting)
    return report_on(divided, model)


def train_and_evaluate(raw: DataFrame, test_size: float = TEST_SHARE, **fitting) -> dict:
    """The same job with its ``model`` beside the tables."""
    model, divided = _trained(raw, test_size, fitting)
    return {"model": model} | report_on(divided, model)


def sweep(train: DataFrame, validation: DataFrame, strengths: list[float], text: str = "Review", label: str = "label",
          id_col: str = "review_id", max_features: int = MAX_FEATURES, max_iter: int = MAX_ITERATIONS) -> DataFrame:
    """One headline row per penalty strength, scored on the validation rows.

    Features are fitted once and the vectors of both parts stored once; only the learner is fitted per strength.
    """
    stages = fit_stages(train, text, id_col, max_features)
    learned, judged = vectors_of(stages, train, label), vectors_of(stages, validation, label)
    tried = None
    for strength in strengths:
        predicted = fit_learner(learned, max_iter, strength).transform(judged).select(
            F.col("label").cast("int").alias("label"), F.col("_prediction").cast("int").alias("y_pred"))
        counts = stored(metrics.pair_counts(predicted, "label", "y_pred"), "pairs")
        row = metrics.headline(counts).select(F.lit(float(strength)).alias("strength"), "accuracy", "macro_f1", "weighted_f1")
        tried = row if tried is None else tried.unionByName(row)
    return tried


def best_by_macro_f1(tried: DataFrame) -> DataFrame:
    """The setting with the highest macro F1; the earliest (smallest strength) on a tie."""
    return tried.agg(F.max_by(F.struct(*tried.columns), F.struct("macro_f1", -F.col("strength"))).alias("b")).select("b.*")
