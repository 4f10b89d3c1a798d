import hashlib
import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from plateview.operators import splits


def brute(rows, held_out, seed):
    """Largest remainder and full sorts, in plain Python."""
    sizes = Counter(label for _, label in rows)
    total = len(rows)
    stay = total - math.ceil(held_out * total)
    quota = {c: n * stay // total for c, n in sizes.items()}
    for c in sorted(sizes, key=lambda c: (-(sizes[c] * stay % total), c))[: stay - sum(quota.values())]:
        quota[c] += 1
    result = {}
    for c in sizes:
        keys = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest() + f":{i}", i) for i, label in rows if label == c)
        for rank, (_, i) in enumerate(keys):
            result[i] = "train" if rank < quota[c] else "test"
    return result


@pytest.fixture(scope="module")
def rows():
    return [(i, 0 if i % 3 == 0 else (1 if i % 7 == 0 else 2)) for i in range(2003)]


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_two_way_matches_brute_force_under_any_partitioning(spark, rows, partitions):
    table = spark.createDataFrame(rows, "id long, label int").repartition(partitions)
    got = {r["id"]: r["split"] for r in splits.split_two_way(table, "id", "label").collect()}
    assert got == brute(rows, 0.2, 42)


def test_published_test_sizes(spark):
    sizes = spark.createDataFrame([(0, 2415), (1, 1165), (2, 5783)], "label int, n long")
    quotas = {r["label"]: r["n"] - r["quota"] for r in splits.class_quotas(sizes, 0.2).collect()}
    assert quotas == {0: 483, 1: 233, 2: 1157}


def test_three_way_keeps_the_test_rows_and_is_exhaustive(spark, rows):
    table = spark.createDataFrame(rows, "id long, label int")
    two = {r["id"] for r in splits.split_two_way(table, "id", "label").collect() if r["split"] == "test"}
    three = splits.split_three_way(table, "id", "label").collect()
    assert len(three) == len(rows) == len({r["id"] for r in three})
    assert {r["id"] for r in three if r["split"] == "test"} == two
    sizes = Counter(r["split"] for r in three)
    assert sizes["validation"] == math.ceil(0.1 * (len(rows) - sizes["test"]))


def test_sixty_rows_with_two_classes(spark):
    table = spark.createDataFrame([(i, f"review number {i}", 2 if i % 2 == 0 else 0) for i in range(60)], "id long, t string, label int")
    divided = splits.split_two_way(table, "id", "label", 0.25)
    assert {r["split"]: r["n"] for r in splits.split_sizes(divided).collect()} == {"train": 45, "test": 15}
    splits.assert_no_leak(divided, "t", ["train", "test"])


def test_single_row_class_is_refused(spark):
    table = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, label int")
    with pytest.raises(PySparkException, match="single row"):
        splits.split_two_way(table, "id", "label").collect()


def test_leaks_are_found(spark):
    table = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("b", "train"), ("c", "test")], "t string, split string")
    leaks = splits.leaked_texts(table, "t", ["train", "validation", "test"]).collect()
    assert [(r["n_splits"], r["n_rows"]) for r in leaks] == [(2, 2)]
    with pytest.raises(ValueError, match="1 texts"):
        splits.assert_no_leak(table, "t", ["train", "test"])


def test_folds_cut_every_class_exactly(spark):
    rows = [(i, i % 3 if i < 200 else 3) for i in range(203)] + [(1000 + i, None) for i in range(7)]
    table = spark.createDataFrame(rows, "review_id long, label int").repartition(5)
    found = {r.review_id: (r.label, r.fold) for r in splits.stratified_folds(table, "review_id", "label", 5).collect()}
    assert set(found) == {i for i, _ in rows}
    for label in (0, 1, 2, 3, None):
        own = sorted((i for i, x in rows if x == label), key=lambda i: f"{hashlib.md5(f'42:{i}'.encode()).hexdigest()}:{i}")
        n = len(own)
        assert {i: found[i][1] for i in own} == {i: sum(r > n * j // 5 for j in range(1, 5)) for r, i in enumerate(own, 1)}
    assert splits.stratified_folds(table.limit(0), "review_id", "label", 3).collect() == []
    with pytest.raises(ValueError, match="folds"):
        splits.stratified_folds(table, "review_id", "label", 1)


def test_cross_validation_judges_every_row_once(spark):
    from plateview.operators import gradient

    rows = [(i, f"{['awful slow', 'okay average', 'great lovely'][i % 3]} food {i % 4}", i % 3) for i in range(48)]
    tables = gradient.cross_validated(spark.createDataFrame(rows, "review_id long, Review string, label int"), 3, steps=6, max_features=40)
    assert tables["headline"].first().n == 48 and tables["headline"].first().accuracy > 0.9
