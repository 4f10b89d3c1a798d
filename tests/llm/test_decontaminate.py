import random

from brute import contamination

from plateview.llm import decontaminate


def _case(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "Dé", "e9", "the", "of"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14, 25])))) for i in range(12)]
    items += [(50, None), (51, items[5][1]), (7, "the, of; THE")]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            body = rng.choice(items)[1] or ""
            own = body.split()
            parts += own[rng.randint(0, 3):] + [rng.choice(["zz", "a", "b", "!"]) for _ in range(rng.randint(0, 8))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts).upper() if rng.random() < 0.3 else " ".join(parts)))
    return docs + [(100, None), (101, "")], items


def _check(spark, docs, items, **options):
    documents = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.matches(documents, benchmark, **options).collect()}
    assert found == {i: contamination(t, items) for i, t in docs}


def test_windows_match_brute_force(spark):
    docs, items = _case(1)
    _check(spark, docs, [i for i in items if len((i[1] or "").split()) != 1])
    _check(spark, docs, items)


def test_benchmark_in_blocks(spark):
    docs, items = _case(2)
    _check(spark, docs, items, block_bytes=30, keep=["doc_id"])


def test_longest_match_and_spans(spark):
    item = " ".join(f"t{i}" for i in range(30))
    documents = spark.createDataFrame([(1, "x y t3 " + " ".join(f"t{i}" for i in range(4, 25)) + " z")], "doc_id long, text string")
    row = decontaminate.matches(documents, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert row.longest == 22 and [(s.first, s.words) for s in row.spans] == [(2, 22)]


def test_empty_tables_and_removal(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "q", None)], "doc_id long, text string, source string")
    assert [r.n_hit for r in decontaminate.matches(docs, none).collect()] == [0, 0, 0]
    assert decontaminate.matches(docs.limit(0), none).collect() == []
    kept = decontaminate.decontaminated(docs, spark.createDataFrame([(1, "B c")], "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "q", None)]
