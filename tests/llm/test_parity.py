import random

import numpy as np
import pytest
from brute import near_components, shingles
from pyspark.sql import functions as F

from plateview.llm import parity
from plateview.llm.buffers import U64
from plateview.llm.closing import _ranked_differences, candidates, closed, distances, stars


def _found(spark, docs, percent=80):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.component_id, r.n_shingles) for r in parity.similar_sets(table, percent=percent).collect()}


def _wanted(docs, percent=80):
    least = near_components(docs, percent)
    return {i: (least[i], len(shingles(t))) for i, t in docs}


@pytest.mark.parametrize("percent", [80, 75, 60])
def test_equals_brute_force(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(8)]
    docs = []
    for i in range(200):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            del own[rng.randrange(len(own)):][:rng.randint(0, 4)]
        docs.append((i * 3 + 1, rng.choice([" ", "\n", " \t"]).join(own).upper() if rng.random() < 0.1 else " ".join(own)))
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, None), (2000, "long " * 30_000 + "end")]
    assert _found(spark, docs, percent) == _wanted(docs, percent)


def _template(seed, n, length=60):
    """Texts that differ from one template by one to eight words of their own."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(length)]
    docs = []
    for i in range(n):
        own = list(template)
        for _ in range(rng.randint(1, 8)):
            k = rng.randrange(len(own))
            rng.choice([lambda: own.__setitem__(k, f"x{rng.randrange(10**9)}"), lambda: own.pop(k), lambda: own.insert(k, f"x{rng.randrange(10**9)}")])()
        docs.append((i, " ".join(own)))
    return docs


def test_template_group(spark):
    docs = _template(5, 300)
    want = _wanted(docs)
    assert len({c for c, _ in want.values()}) > 50      # many stay apart
    assert _found(spark, docs) == want


def test_template_group_compares_few_pairs(spark):
    """Of 2,000 texts of a template half are not linked to the hub; far fewer pairs meet than the two million there are."""
    docs = _template(6, 2000)
    names: dict = {}
    sets = {i: sorted({names.setdefault(s, len(names)) for s in shingles(t)}) for i, t in docs}
    members = spark.createDataFrame([(0, i) for i in sets], "bucket long, id long")
    bodies = spark.createDataFrame(list(sets.items()), "id long, shingles array<long>").cache()
    found = dict(closed(members, bodies, 80).collect())
    links, held = [], {i: frozenset(s) for i, s in sets.items()}
    for i in held:
        for j in range(i):
            both = len(held[i] & held[j])
            if 100 * both >= 80 * (len(held[i]) + len(held[j]) - both):
                links.append((i, j))
    least = list(range(len(docs)))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, j in links:
        a, b = top(i), top(j)
        least[max(a, b)] = min(a, b)
    assert {i: found.get(i, i) for i in sets} == {i: top(i) for i in sets}
    star = distances(stars(members), bodies, 80)
    assert star.count() == 2000 and star.filter("not linked").count() > 500
    before = star.withColumn("component", F.when(F.col("linked"), F.col("hub")).otherwise(F.col("id")))
    assert candidates(_ranked_differences(before, bodies), 80).count() < 20_000


def test_common_passage_and_copies(spark):
    """A passage in all texts, groups of copies, and near copies of some of them."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(120)]
    docs = [(i, " ".join(passage + [f"x{rng.randrange(10**6)}" for _ in range(100)])) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(80)]
    for i in range(300, 310):
        own = docs[i - 300][1].split()
        own[-20] = "changed"
        docs.append((i, " ".join(own)))
    assert _found(spark, docs) == _wanted(docs)


def test_blocks_are_counted_the_same_however_they_arrive(spark, monkeypatch):
    docs = _template(7, 150, 40)
    monkeypatch.setattr(parity, "COMMON", 12)
    monkeypatch.setattr(parity, "PENDING", 50)
    monkeypatch.setattr(parity, "BATCH_BYTES", 500)
    monkeypatch.setattr(parity, "CHUNK_BYTES", 200)
    batches = list(parity._sketched(8, 80)(spark.createDataFrame(docs, "doc_id long, text string").toArrow().to_batches()))
    few = list(parity._chosen(80)(b for b in list(parity._counted(8)(iter(batches)))))
    monkeypatch.setattr(parity, "PENDING", 10**9)
    whole = list(parity._chosen(80)(b for b in list(parity._counted(8)(iter(batches)))))

    def rows(found):
        return sorted((r["kind"], r["doc_id"], r["k1"], r["k2"] or 0, r["n_shingles"] or 0) for b in found for r in b.to_pylist() if r["kind"] >= parity._PAIR)

    def shared(found):      # pairs are counted in every task that ends
        return [r for r in rows(found) if r[0] != parity._PAIR]

    assert rows(few) == rows(whole) and shared(whole)


def test_odd_tables(spark):
    docs = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 3), (3, "z y x", 4), (3, "q r s", 5), (9, "q r s", 6), (10, "z y x", 7)]
    table = spark.createDataFrame(docs, "doc_id long, text string, component_id long").withColumnRenamed("component_id", "bucket")
    found = parity.similar_sets(table).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted(
        [(None, None), (5, 5), (5, 5), (3, 3), (3, 3), (9, 3), (10, 3)], key=str)
    assert parity.similar_sets(table.limit(0)).collect() == []
    assert [tuple(r) for r in parity.similar_sets(table.select("doc_id", "text").filter("text is null").union(
        spark.createDataFrame([(1, None)], "doc_id long, text string"))).collect()] == [(1, 0, 1)]
    words = " ".join(f"w{i}" for i in range(30))
    near = spark.createDataFrame([(1, words), (1, words), (2, words + " more"), (2, "other words than those")], "doc_id long, text string")
    assert sorted(tuple(r) for r in parity.similar_sets(near).collect()) == [(1, 26, 1), (1, 26, 1), (2, 1, 2), (2, 27, 1)]


def test_equal_blocks_bound_the_difference():
    """Sets that differ in d elements differ in at most d blocks; empty blocks are told from others."""
    rng = np.random.default_rng(1)
    for n in (5, 40, 700):
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1))
        other = np.unique(np.concatenate([one[2:], rng.integers(0, 2**63, 2, dtype=np.int64).astype(U64)]))
        band = parity.bands_of(np.array([len(other)]), 80)[0].repeat(2)
        token, owner = parity.block_tokens([one, other], band, 80)
        width = parity.blocks(80)[band[0]]
        assert len(token) == 2 * width and (owner == np.repeat([0, 1], width)).all()
        assert (token[:width] != token[width:]).sum() <= len(np.setxor1d(one, other))
