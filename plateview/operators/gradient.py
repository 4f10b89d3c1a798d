"""Penalised multinomial regression as a fixed number of relational steps, which another engine can repeat.

A text is one row with its sparse features, the model a table with a row per feature. A step multiplies the rows by the model,
takes the residuals of the probabilities, sums them by feature within each task and then over tasks, and moves the model along an accelerated
gradient (Nesterov). Features are a top-k, so the model is small: it is sent to the tasks as one dense array, they take the packed rows of many
texts at a time, and what a step shuffles is a row per feature and task. Step size and number are given beforehand, so equal inputs give equal models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plateview.functions import vectors as vx
from plateview.operators import features, metrics, splits
from plateview.operators.joins import bounded
from plateview.schemas import BLOCK_BYTES, LABEL_NAMES, MAX_FEATURES
from plateview.sources.scratch import measured_bytes, stored

STEPS = 100
BLOCK_ENTRIES = 1 << 17     # features that a task multiplies at once
PACKED = ["places", "ends", "at", "x"]
DIGITS = 9      # to which scores are compared, so that a tie does not hang on the order of summation


class StepModel(NamedTuple):
    """``vocabulary(i, term, idf)`` and ``weights(i, w)``, an array with an entry per class; the row after the last feature is the intercept."""

    vocabulary: DataFrame
    weights: DataFrame
    classes: list[int]


def numbered(train: DataFrame, text: str, id_col: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(i, term, idf)`` of the training rows' most frequent n-grams, numbered from 0 in the order of the terms."""
    vocab = stored(features.vocabulary(train, id_col, text, max_features), "vocabulary")
    place = (F.row_number().over(Window.orderBy("term")) - 1).alias("i")       # a top-k
    return stored(features.with_idf(vocab, train).select(place, "term", "idf"), "numbered")


def rows_of(texts: DataFrame, vocabulary: DataFrame, text: str, keep: list[str], max_features: int = MAX_FEATURES) -> DataFrame:
    """``keep`` columns and ``feats``, an array of ``(i, x)`` with unit length, and 1 for the intercept, stored for the steps."""
    n = vocabulary.agg(F.count(F.lit(1)).cast("int")).scalar()
    sparse = features.sparse_rows(texts, keep, text, vocabulary)
    one = F.array(F.struct(F.col("_n").alias("i"), F.lit(1.0).alias("x")))
    return stored(sparse.withColumn("_n", n).select(*keep, F.concat("feats", one).alias("feats")), "rows")


def _held(weights: DataFrame, column: str, max_features: int) -> Column:
    """The model as one array, all classes of a feature side by side."""
    small = bounded(weights.select("i", column), max_features + 1, "features")
    return small.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col(column).alias("w")))), lambda r: r["w"]))).scalar()


def _scores(held: Column, n_classes: int) -> Column:
    def score(c: int) -> Column:
        return F.aggregate("feats", F.lit(0.0), lambda s, f: s + f["x"] * F.get(held, f["i"] * n_classes + c))
    return F.array(*[score(c) for c in range(n_classes)])


def _gradient(rows: DataFrame, weights: DataFrame, column: str, classes: list[int], n: int, max_features: int) -> DataFrame:
    """``(i, g)``: the mean over rows of the residuals times the feature."""
    k = len(classes)
    scored = rows.withColumn("_m", _held(weights, column, max_features)).select("label", "feats", _scores(F.col("_m"), k).alias("z"))
    share = scored.select("label", "feats", vx.softmax(F.col("z")).alias("p"))
    rest = share.select("feats", *[(F.get("p", F.lit(c)) - (F.col("label") == F.lit(y)).cast("double")).alias(f"r{c}") for c, y in enumerate(classes)])
    each = rest.select(F.explode("feats").alias("f"), *[f"r{c}" for c in range(k)])
    sums = each.groupBy(F.col("f.i").alias("i")).agg(*[F.sum(F.col("f.x") * F.col(f"r{c}")).alias(f"g{c}") for c in range(k)])
    return sums.select("i", F.array(*[F.col(f"g{c}") / n for c in range(k)]).alias("g"))


def _packed(labelled: DataFrame) -> DataFrame:
    """``(places, ends, at, x)`` of ``(place, feats)``: many rows as one, their features side by side, stored for the steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, feats = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32), batch.column(1)
            ends = feats.offsets.to_numpy().astype(np.int64)
            at, x = (feats.values.field(f).to_numpy(zero_copy_only=False) for f in ("i", "x"))
            low = 0
            while low < len(place):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK_ENTRIES, side="right")) - 1)
                part = slice(ends[low], ends[high])
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (
                    place[low:high], ends[low + 1: high + 1] - ends[low], at[part].astype(np.int32), x[part].astype(np.float64))], names=PACKED)
                low = high

    return stored(labelled.mapInArrow(run, ", ".join(f"{c} binary" for c in PACKED)), "packed")


def _slopes(held: Broadcast, k: int) -> Callable:
    """Sums ``(i, g0, g1, ...)`` over a task's rows of the residuals times the feature, for models side by side with ``k`` classes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = held.value
        total = np.zeros(ahead.shape)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in PACKED)):
                place, ends, at, x = (np.frombuffer(c.as_py(), kind) for c, kind in zip(row, (np.int32, np.int64, np.int32, np.float64)))
                begins = np.append(0, ends[:-1])
                z = np.add.reduceat(ahead[at] * x[:, None], begins, axis=0).reshape(len(place), -1, k)
                p = np.exp(z - z.max(axis=2, keepdims=True))
                p /= p.sum(axis=2, keepdims=True)
                p -= (place[:, None] == np.arange(k))[:, None, :]
                rest = np.repeat(p.reshape(len(place), -1), ends - begins, axis=0)
                for c in range(total.shape[1]):
                    total[:, c] += np.bincount(at, rest[:, c] * x, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *map(pa.array, total.T)],
                                         names=["i", *[f"g{c}" for c in range(total.shape[1])]])
    return run


def fit_each(rows: DataFrame, vocabulary: DataFrame, classes: list[int], strengths: list[float], steps: int = STEPS,
             max_features: int = MAX_FEATURES) -> list[StepModel]:
    """A model per strength after ``steps`` steps on ``rows(label, feats)``; ``strength`` is the inverse weight of the penalty against the sum of losses.

    All models take a step in one pass over the rows. The intercept is not penalised. Rows have unit length and an intercept, so the mean loss
    bends by less than 1 and the step is 1 / (1 + penalty). Rows of other labels push all classes down, rows without a label only count; no rows
    leave the model at zero. The coefficients of the steps are on the driver.
    """
    spark, k, n, last = rows.sparkSession, len(classes), rows.count(), vocabulary.count()
    if last > max_features:
        raise ValueError(f"features: more than {max_features} rows")
    penalty = np.repeat([1.0 / (strength * max(n, 1)) for strength in strengths], k)
    pull = np.repeat(penalty[None, :], last + 1, axis=0)
    pull[last] = 0.0
    now = ahead = np.zeros((last + 1, len(penalty)))
    if n and steps:
        place = F.coalesce(*[F.when(F.col("label") == F.lit(y), F.lit(c)) for c, y in enumerate(classes)], F.lit(-1))
        packed = _packed(rows.filter(F.col("label").isNotNull() & (F.size("feats") > 0)).select(place.alias("place"), "feats"))
        packed = packed.coalesce(max(spark.sparkContext.defaultParallelism, measured_bytes(packed) // BLOCK_BYTES))
        sums = [f"g{c}" for c in range(len(penalty))]
    for t in range(steps if n else 0):
        held = spark.sparkContext.broadcast(ahead)
        made = packed.mapInArrow(_slopes(held, k), ", ".join(["i int", *[f"{g} double" for g in sums]]))
        found = made.groupBy("i").agg(*[F.sum(g).alias(g) for g in sums]).toArrow()
        slope = np.zeros(now.shape)
        slope[found.column("i").to_numpy()] = np.stack([found.column(g).to_numpy() for g in sums], axis=1)
        held.unpersist()
        moved = ahead - (slope / n + pull * ahead) / (1.0 + penalty)
        now, ahead = moved, moved + t / (t + 3.0) * (moved - now)
    return [StepModel(vocabulary, _weights(spark, now[:, c: c + k]), classes) for c in range(0, len(penalty), k)]


def _weights(spark: SparkSession, values: np.ndarray) -> DataFrame:
    table = pa.table({"i": pa.array(np.arange(len(values), dtype=np.int32)), "w": pa.array(values.tolist(), pa.list_(pa.float64()))})
    return stored(spark.createDataFrame(table), "weights")


def fit(rows: DataFrame, vocabulary: DataFrame, classes: list[int], steps: int = STEPS, strength: float = 1.0, max_features: int = MAX_FEATURES) -> StepModel:
    """``fit_each`` for one strength."""
    return fit_each(rows, vocabulary, classes, [strength], steps, max_features)[0]


def gradient_norm(rows: DataFrame, model: StepModel, strength: float = 1.0, max_features: int = MAX_FEATURES) -> float:
    """Length of the gradient of the penalised mean loss: 0 at the optimum."""
    n = max(rows.count(), 1)
    slope = _gradient(rows, model.weights, "w", model.classes, n, max_features).join(model.weights, "i")
    last = F.max("i").over(Window.partitionBy())
    pull = F.when(F.col("i") < last, F.lit(1.0 / (strength * n))).otherwise(0.0)
    whole = slope.select(F.zip_with("g", "w", lambda g, w: g + pull * w).alias("g"))
    return float(whole.agg(F.sqrt(F.sum(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 0.0)


def predict(rows: DataFrame, model: StepModel, max_features: int = MAX_FEATURES) -> DataFrame:
    """``rows`` with ``y_pred`` in place of the features: the class of the highest score, the first on a tie."""
    keep = [c for c in rows.columns if c != "feats"]
    scored = rows.withColumn("_m", _held(model.weights, "w", max_features)).select(*keep, _scores(F.col("_m"), len(model.classes)).alias("_z"))
    names = F.array(*[F.lit(c) for c in model.classes])
    best = vx.argmax(F.transform("_z", lambda z: F.round(z, DIGITS)))
    return scored.select(*keep, F.get(names, best).alias("y_pred"))


def _judged(divided: DataFrame, text: str, label: str, id_col: str, steps: int, strength: float, max_features: int) -> DataFrame:
    """Counts ``(y_true, y_pred, n)`` on the test rows of a split, with features and model fitted on its training rows."""
    train = divided.filter(F.col("split") == "train")
    vocabulary = numbered(train, text, id_col, max_features)
    keep = [id_col, label]
    model = fit(rows_of(train, vocabulary, text, keep, max_features).withColumnRenamed(label, "label"), vocabulary, sorted(LABEL_NAMES),
                steps, strength, max_features)
    judged = predict(rows_of(divided.filter(F.col("split") == "test"), vocabulary, text, keep, max_features), model, max_features)
    return stored(metrics.pair_counts(judged, label, "y_pred"), "pairs")


def _tables(counts: DataFrame) -> dict[str, DataFrame]:
    return {"report": metrics.report(counts, metrics.ALL_LABELS, LABEL_NAMES), "confusion": metrics.confusion(counts, metrics.ALL_LABELS),
            "headline": metrics.headline(counts)}


def report_of_steps(divided: DataFrame, text: str = "Review", label: str = "label", id_col: str = "review_id", steps: int = STEPS,
                    strength: float = 1.0, max_features: int = MAX_FEATURES) -> dict[str, DataFrame]:
    """Features and model fitted on the training rows of a split, judged on its test rows: ``report``, ``confusion``, ``headline``."""
    return _tables(_judged(divided, text, label, id_col, steps, strength, max_features))


def cross_validated(rated: DataFrame, k: int = 5, text: str = "Review", label: str = "label", id_col: str = "review_id", steps: int = STEPS,
                    strength: float = 1.0, max_features: int = MAX_FEATURES) -> dict[str, DataFrame]:
    """The same tables over all rows, each judged by a model fitted without its fold."""
    folds = stored(splits.stratified_folds(rated, id_col, label, k), "folds")
    pooled = None
    for fold in range(k):
        divided = folds.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))
        counts = _judged(divided, text, label, id_col, steps, strength, max_features)
        pooled = counts if pooled is None else pooled.unionByName(counts)
    return _tables(stored(pooled.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n")), "pairs"))


def sweep_of_steps(train: DataFrame, validation: DataFrame, strengths: list[float], text: str = "Review", label: str = "label", id_col: str = "review_id",
                   steps: int = STEPS, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(strength, accuracy, macro_f1, weighted_f1)`` on the validation rows; features are fitted once, and all models in the same passes."""
    vocabulary = numbered(train, text, id_col, max_features)
    learned, judged = (rows_of(part, vocabulary, text, [id_col, label], max_features).withColumnRenamed(label, "label") for part in (train, validation))
    tried = None
    for strength, model in zip(strengths, fit_each(learned, vocabulary, sorted(LABEL_NAMES), strengths, steps, max_features)):
        counts = stored(metrics.pair_counts(predict(judged, model, max_features), "label", "y_pred"), "pairs")
        row = metrics.headline(counts).select(F.lit(float(strength)).alias("strength"), "accuracy", "macro_f1", "weighted_f1")
        tried = row if tried is None else tried.unionByName(row)
    return tried
