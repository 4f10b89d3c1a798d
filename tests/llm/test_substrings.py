import random

import numpy as np
from brute import substring_dedup

from plateview.llm import substrings


def _case(seed, n=24):
    rng = random.Random(seed)
    docs = []
    base = ["".join(rng.choice(alphabet) for _ in range(1200)) for alphabet in ("ab", "abcdefgh ", "aé\n", "x")]
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            body = rng.choice(base)
            a = rng.randrange(len(body))
            text += body[a:a + rng.randint(0, 300)] + "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 30)))
        docs.append((1000 - i * 7, text))
    return docs + [(1, None), (2, ""), (3, "short"), (5000, docs[0][1]), (5000, docs[1][1]), (5000, docs[1][1])]


def _rows(table):
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in table.collect())


def test_removal_matches_brute_force(spark):
    for seed in (1, 2):
        docs = _case(seed)
        table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string")
        assert _rows(substrings.without_repeats(table)) == substring_dedup(docs)


def test_small_batches_long_texts_and_frequent_grams(spark, monkeypatch):
    """Many batches and parts, texts longer than a chunk, and any choice of frequent grams give the same rows."""
    docs = _case(3)
    docs[4] = (docs[4][0], docs[0][1] + "".join(t or "" for _, t in docs[5:20]))
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3_000)
    monkeypatch.setattr(substrings, "PART_BYTES", 3_000)
    monkeypatch.setattr(substrings, "frequent_grams", lambda d: np.unique(
        substrings.Hashes(np.frombuffer(docs[4][1].encode(), np.uint8)).grams()[::5] & substrings.KEPT_BITS))
    assert _rows(substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == substring_dedup(docs)


def test_contexts_keep_64_bits_in_messages():
    """Equal contexts have equal hashes wherever they stand, others differ in all parts of the hash, and a message keeps them."""
    rng = np.random.default_rng(5)
    body = rng.integers(97, 123, 3000).astype(np.uint8)
    data = np.concatenate([body, rng.integers(97, 123, 777).astype(np.uint8), body])
    runs = substrings.Runs(data, np.array([0, 3000, 3777, 6777]), np.zeros(0, np.uint64))
    first, last = runs.context[runs.doc == 0], runs.context[runs.doc == 2]
    assert (first == last).all() and len(np.unique(first)) == len(first)
    assert all(len(np.unique(first >> np.uint64(s) & np.uint64(0xFF))) > len(first) // 4 for s in (0, 24, 56))
    flag, doc = np.zeros(len(runs.doc), bool), runs.doc.astype(np.int64)
    sent = substrings._unpack(substrings._pack([runs.gram, runs.context, doc, flag], substrings._RUN), substrings._RUN)
    assert (sent[0] == runs.gram).all() and (sent[1] == runs.context).all() and (sent[1] >> np.uint64(40)).any()


def test_pieces_cover_every_window_of_long_texts(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 300)
    ends = np.array([0, 40, 2000, 2100, 2800])
    seen = []
    for first, offset, bounds in substrings._pieces(ends):
        for d in range(len(bounds) - 1):
            seen += [(first + d, offset + q) for q in range(bounds[d], bounds[d + 1] - 49)]
    want = [(d, q) for d in range(4) for q in range(ends[d], ends[d + 1] - 49)]
    assert sorted(seen) == want


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 900)
    hashes = substrings.Hashes(data)
    places = rng.permutation(800)
    groups = np.sort(rng.integers(0, 5, 800))
    got = places[substrings.merge_sorted(hashes, np.arange(800), groups, places)]
    for g in range(5):
        own = places[groups == g]
        want = sorted(own, key=lambda p: bytes(data[p:p + 50]))
        assert [bytes(data[p:p + 50]) for p in got[groups == g]] == [bytes(data[p:p + 50]) for p in want]
        assert sorted(got[groups == g]) == sorted(own)


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
