import random

import numpy as np
from brute import near_components, shingles

from plateview.llm import minhash
from plateview.llm.buffers import byte_column
from plateview.llm.components import components, star_components

import pyarrow as pa


def _variants(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(8)]
    docs = []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        text = rng.choice([" ", "\n", " \t"]).join(own)
        docs.append((i * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    return docs


def test_components_match_brute_force(spark):
    docs = _variants(1, 160) + [(1000, None), (1001, ""), (1002, " \n "), (1003, None)]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(table).collect()}
    least = near_components(docs)
    assert found == {i: (least[i], len(shingles(t))) for i, t in docs}


def test_rows_without_ids_and_repeats(spark):
    docs = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "z y x"), (3, "q r s"), (9, "q r s"), (10, "z y x")]
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted(
        [(None, None), (5, 5), (5, 5), (3, 3), (3, 3), (9, 3), (10, 3)], key=str)
    kept = minhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "5", "5", "None"]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_star_compares_members_that_the_centre_does_not_reach(spark):
    """1 - 2 - 3 - 4 is a chain: the centre 1 is similar to 2 only, and nothing links 9."""
    sets = {1: range(0, 8), 2: range(1, 9), 3: range(2, 10), 4: range(3, 11), 9: range(50, 58)}
    rows = [(0, i, 8) for i in sets]
    members = spark.createDataFrame(rows, "bucket long, id long, size long")
    bodies = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, shingles array<long>")
    assert dict(star_components(members, bodies, 75).collect()) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_large_bucket_of_unlinked_members_ends(spark):
    rng = random.Random(3)
    sets = {i: sorted(rng.sample(range(100_000), 6)) for i in range(90)}
    sets[89] = sets[88][:5] + [999_999]
    members = spark.createDataFrame([(0, i, 6) for i in sets], "bucket long, id long, size long")
    bodies = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, shingles array<long>")
    found = {k: v for k, v in star_components(members, bodies, 70).collect() if k != v}
    assert found == {89: 88}


def test_crowded_buckets_are_split(spark, monkeypatch):
    """A passage in all texts crowds the buckets; the links among them are still found."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(300)]
    docs = []
    for i in range(140):
        docs.append((i, " ".join(passage + [f"x{rng.randrange(10**6)}" for _ in range(160)])))
    for i in range(140, 150):
        own = docs[i - 140][1].split()
        own[-20] = "changed"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(minhash, "FEW", 2)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == near_components(docs)


def test_components_of_a_long_path(spark):
    """The same by one task and by rounds of joins."""
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (7, 7), (None, 3), (100, 101)], "a long, b long")
    for few in (1000, 0):
        assert dict(components(links, few).collect()) == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}
    assert components(links.limit(0), 0).collect() == []


def test_sketch_agreement_estimates_similarity():
    texts = [" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(40, 440))]
    sets = list(minhash.shingle_sets(*byte_column(pa.array(texts))))
    shared = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    bands = [minhash.bands_of(s) for s in sets]
    assert abs((bands[0] == bands[1]).mean() - shared**minhash.ROWS) < 0.25
    assert (minhash.bands_of(sets[0][:1]) == minhash.bands_of(sets[0][:1])).all()


def test_peripheral_member_links_a_text_that_the_centre_does_not_reach(spark):
    """Text 500 is similar to 400 only, which no slot keeps beside 200 more central members of its component."""
    core = list(range(100))
    sets = {i: core[:95] + [1000 * i + j for j in range(5)] for i in range(1, 200)} | {0: core}
    sets[400] = core[:90] + [400_000 + j for j in range(10)]
    sets[500] = core[10:90] + [400_000 + j for j in range(10)] + [500_000 + j for j in range(10)]
    rows = [(b, i, len(x), 1 if i >= 400 else 10_000 if i == 0 else 1000 - i) for i, x in sets.items() for b in (0, 1)]
    members = spark.createDataFrame(rows, "bucket long, id long, size long, central long")
    bodies = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, shingles array<long>")
    found = dict(minhash.joined_buckets(members, bodies, 75).collect())
    assert {i: found.get(i) for i in sets} == {i: 0 for i in sets}


def test_crowded_bucket_is_closed(spark):
    """Every text shares 0.7 of one template; the linked pairs share no bucket but the crowded one."""
    template = list(range(100))
    sets = {i: template[:82] + [1000 * i + j for j in range(18)] for i in range(150)}
    for i in range(150, 156):
        sets[i] = sets[i - 140][:95] + [1000 * i + j for j in range(5)]
    members = spark.createDataFrame([(0, i, 100, 1) for i in sets], "bucket long, id long, size long, central long")
    bodies = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, shingles array<long>")
    found = dict(minhash.joined_buckets(members, bodies, 75).collect())
    assert {i: found.get(i, i) for i in sets} == {i: i - 140 if i >= 150 else i for i in sets}
