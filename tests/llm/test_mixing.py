import itertools

from pyspark.sql import functions as F

from plateview.llm import mixing


def test_water_filling_shares_the_excess():
    assert mixing.water_filled([10, 10], [1, 3]) == [5.0, 15.0]
    targets = mixing.water_filled([100, 1, 1], [1, 2, 3])
    assert targets == [96.0, 3.0, 3.0]
    assert mixing.water_filled([0, 0], [1, 2]) == [0.0, 0.0] and mixing.water_filled([], []) == []


def test_flow_is_the_cheapest_that_fills_the_quotas():
    patterns = [(("a",), 2), (("a", "b"), 3), (("b",), 1)]
    for quotas in ({"a": 4, "b": 4}, {"a": 9, "b": 1}, {"a": 0, "b": 12}, {"a": 20, "b": 20}):
        found = mixing.routed(patterns, quotas, 2)
        best = None
        for x, y, z, w in itertools.product(range(5), range(7), range(7), range(3)):
            if y + z > 6 or x + y > quotas["a"] or z + w > quotas["b"]:
                continue
            cost = max(x - 2, 0) + max(y + z - 3, 0) + max(w - 1, 0)
            key = (-(x + y + z + w), cost)
            best = key if best is None else min(best, key)
        use = {p: sum(v for (q, _), v in found.items() if q == p) for p, _ in patterns}
        cost = sum(max(use[p] - size, 0) for p, size in patterns)
        assert (-sum(found.values()), cost) == best
        for s, quota in quotas.items():
            assert sum(v for (_, t), v in found.items() if t == s) <= quota


def _documents(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "x y z", None) for i in range(30)] + [(2000, None, "s1"), (2001, "", "s1"), (2002, "a b", "s1"), (2002, "a b", "s1"), (None, "q", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_every_source_comes_near_its_target(spark):
    documents, rows = _documents(spark)
    mix, sizes, targets = mixing.mix_by_weight(documents, F.array("source"))
    found = mix.collect()
    assert len(found) == len(rows)
    for s in {r[2] for r in rows}:
        own = [r for r in found if r.pattern[0] == s]
        assert sizes[s] == sum(len((t or "").split()) for _, t, x in rows if x == s) == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= 2
    assert all(r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in found)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    # Weights by code point, NULL last: s0 s1 s2 s3 None weigh 1 2 3 1 2.
    assert list(targets) == ["s0", "s1", "s2", "s3", None]
    again, _, _ = mixing.mix_by_weight(documents.repartition(3), F.array("source"))
    key = lambda r: (str(r.doc_id), r["size"], r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again.collect()))


def test_overlapping_sources_fill_all_quotas(spark):
    rows = [(i, "a b c d e", ["x"] if i < 40 else ["x", "y"] if i < 80 else []) for i in range(100)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    table = mixing.sized(documents, F.col("member"))
    mix = mixing.mixed(table, mixing._totals(table, 10), {"x": 250, "y": 150})
    use = {tuple(r.pattern): r.taken for r in mix.groupBy("pattern").agg(F.sum("taken").alias("taken")).collect()}
    assert use == {("x",): 200, ("x", "y"): 200, (): 0} and mix.agg(F.max("copies")).first()[0] == 1


def test_empty_table_and_too_many_patterns(spark):
    documents, _ = _documents(spark)
    mix, sizes, targets = mixing.mix_by_weight(documents.limit(0), F.array("source"))
    assert mix.collect() == [] and sizes == {} and targets == {}
    try:
        mixing.mix_by_weight(documents, F.array("source"), max_patterns=2)
        raise AssertionError("no error")
    except ValueError as error:
        assert "patterns" in str(error)
