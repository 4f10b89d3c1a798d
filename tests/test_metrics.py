import pytest

from plateview.operators import metrics
from plateview.schemas import LABEL_NAMES

# The published confusion matrix of the TF-IDF classifier and what follows from it.
MATRIX = [[410, 18, 55], [62, 35, 136], [15, 9, 1133]]
PUBLISHED = {
    "Negative": (0.8418891170431212, 0.8488612836438924, 0.845360824742268, 483),
    "Neutral": (0.5645161290322581, 0.15021459227467812, 0.23728813559322035, 233),
    "Positive": (0.8557401812688822, 0.9792566983578219, 0.913341394598952, 1157),
    "macro avg": (0.7540484757814205, 0.6594441914254642, 0.6653301183114801, 1873),
    "weighted avg": (0.8159402516414525, 0.8424986652429258, 0.8117103083260669, 1873),
}


def test_replay_of_the_published_matrix(spark):
    rows = [(t, p) for t, line in enumerate(MATRIX) for p, n in enumerate(line) for _ in range(n)]
    counts = metrics.pair_counts(spark.createDataFrame(rows, "y_true int, y_pred int"))
    got = {r["class"]: r for r in metrics.report(counts, metrics.ALL_LABELS, LABEL_NAMES).collect()}
    for name, (precision, recall, f1, support) in PUBLISHED.items():
        row = got[name]
        assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((precision, recall, f1), abs=1e-12)
        assert row["support"] == support
    assert got["accuracy"]["f1"] == pytest.approx(0.8424986652429258, abs=1e-12)
    head = metrics.headline(counts).first()
    assert (head["macro_f1"], head["weighted_f1"]) == pytest.approx((0.6653301183114801, 0.8117103083260669), abs=1e-12)
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(counts, metrics.ALL_LABELS).collect()}
    assert [[cells[t, p] for p in range(3)] for t in range(3)] == MATRIX


def test_absent_class_counts_in_the_report_but_not_in_the_headline(spark):
    counts = metrics.pair_counts(spark.createDataFrame([(0, 0), (0, 2), (2, 2), (2, 2)], "y_true int, y_pred int"))
    report = {r["class"]: r for r in metrics.report(counts, metrics.ALL_LABELS, LABEL_NAMES).collect()}
    assert report["Neutral"]["f1"] == 0 and report["Neutral"]["support"] == 0
    head = metrics.headline(counts).first()
    assert report["macro avg"]["f1"] == pytest.approx((2 / 3 + 0.8) / 3)
    assert head["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2)


def test_predicted_only_class_is_observed(spark):
    counts = metrics.pair_counts(spark.createDataFrame([("A", "N"), ("A", "A")], "y_true string, y_pred string"))
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(counts).collect()}
    assert cells == {("A", "A"): 1, ("A", "N"): 1, ("N", "A"): 0, ("N", "N"): 0}
    wide = metrics.confusion_wide(spark.createDataFrame([(0, 1)], "y_true int, y_pred int"), [0, 1]).collect()
    assert sorted((r["y_true"], r["0"], r["1"]) for r in wide) == [(0, 0, 1), (1, 0, 0)]
