"""Classification metrics as relations.

Predictions are reduced to counts per (truth, prediction) first; everything else is
arithmetic on that table, whose size depends on the number of classes alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plateview.operators.joins import bounded
from plateview.schemas import LABEL_NAMES, MAX_CLASSES

ALL_LABELS = sorted(LABEL_NAMES)


def pair_counts(predictions: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """``(y_true, y_pred, n)``; combined before the shuffle."""
    return (predictions.groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def _both_sides(counts: DataFrame) -> DataFrame:
    """Every count seen from its true and from its predicted class: one row per side."""
    side = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    ))
    hit = F.when((F.col("y_true") == F.col("y_pred")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    return (counts.withColumn("s", side)
            .select(F.col("s.label").alias("label"), "s.support", "s.predicted", hit.alias("hits")))


def _spine(counts: DataFrame, labels: list | None) -> DataFrame:
    """The classes to report on: the given ones, or all that occur on either side."""
    kind = counts.schema["y_true"].dataType
    if labels is not None:
        return counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x).cast(kind) for x in labels])).alias("label"))
    seen = _both_sides(counts).select("label").distinct()
    return bounded(seen, MAX_CLASSES, "classes of a report")


def class_scores(counts: DataFrame, labels: list | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support, predicted, hits)``; a division by zero gives 0."""
    sums = (_both_sides(counts).groupBy("label")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")))
    if labels is not None:
        sums = _spine(counts, labels).join(sums, "label", "left").na.fill(0, ["support", "predicted", "hits"])

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return sums.select(
        "label",
        share(F.col("hits"), F.col("predicted")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"),
        share(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "predicted", "hits",
    )


def confusion(counts: DataFrame, labels: list | None = None) -> DataFrame:
    """Dense matrix in long form ``(y_true, y_pred, n)``, zeros included."""
    spine = _spine(counts, labels).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    cells = (spine.select(F.explode("labels").alias("y_true"), "labels")
             .select("y_true", F.explode("labels").alias("y_pred")))
    return cells.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def confusion_wide(predictions: DataFrame, labels: list, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row per true class, one column per predicted class."""
    counts = confusion(pair_counts(predictions, truth, predicted), labels)
    return counts.groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))


def report(counts: DataFrame, labels: list | None = None, names: dict | None = None) -> DataFrame:
    """``(ord, class, precision, recall, f1, support)``: a row per class in the order of its label, then accuracy, macro and weighted averages.

    The number of classes is bounded, so ordering them in one task is, too.
    """
    scores = class_scores(counts, labels)
    if names:
        mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        title = F.try_element_at(mapping, F.col("label"))
    else:
        title = F.col("label").cast("string")
    measures = ["precision", "recall", "f1"]
    rows = scores.select((F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("ord"), title.alias("class"), *measures, "support")
    support = F.sum("support").alias("support")

    def weighted(m: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(m)

    nothing = F.lit(None).cast("double")
    extra = [
        scores.agg(F.count(F.lit(1)).alias("ord"), F.lit("accuracy").alias("class"), nothing.alias("precision"), nothing.alias("recall"),
                   F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("f1"), support),
        scores.agg((F.count(F.lit(1)) + 1).alias("ord"), F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], support),
        scores.agg((F.count(F.lit(1)) + 2).alias("ord"), F.lit("weighted avg").alias("class"), *[weighted(m) for m in measures], support),
    ]
    return reduce(DataFrame.unionByName, extra, rows)


def headline(counts: DataFrame) -> DataFrame:
    """``(accuracy, macro_f1, weighted_f1, n)``; F1 over the classes that occur in truth or prediction."""
    scores = class_scores(counts)
    n = F.sum("support")
    return scores.agg(
        F.try_divide(F.sum("hits"), n).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        n.alias("n"),
    )
