import itertools
import random

import numpy as np

from plateview.llm import secrets


def test_base_spans():
    text = 'Password : "abcdefghijkl" token=short secret=aaaaaaaaaaaa== AKIA' + "Q" * 14 + " AKIAshort " + "0123456789abcdef" + "g" + "a" * 15
    found = [(secrets.KINDS[k], text[a:b]) for a, k, b, _ in secrets.base_spans(text)]
    assert found == [("assign", 'Password : "abcdefghijkl'), ("assign", "secret=aaaaaaaaaaaa=="), ("access", "AKIA" + "Q" * 14), ("hex", "0123456789abcdef")]
    assert secrets.base_spans("") == [] and secrets.base_spans("paſſword=abcdefghijkl") == []
    assert [b - a for a, _, b, _ in secrets.base_spans("é API_KEY='abcdefghijkl'")] == [len("API_KEY='abcdefghijkl")]
    # A short value ends its match, so the next one begins after it.
    assert secrets.base_spans("token=token=abcdefghijklm")[0][0] == 0


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "Word", "value", "of", "x1", "config", "mail", "2024"]
    texts = []
    for i in range(n):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), 'token = "' + "".join(rng.choice("0123456789abcdefXYZ") for _ in range(28)) + '"')
        texts.append(" ".join(parts))
    return texts


def _whole_viterbi(field, scores):
    if not len(scores):
        return []
    best, back = scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + field.moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tag = [int(best.argmax())]
    for step in reversed(back):
        tag.append(int(step[tag[-1]]))
    return tag[::-1]


def test_split_decoding_equals_viterbi_over_whole_sequences():
    rng = np.random.default_rng(2)
    for trial in range(20):
        field = secrets.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)) * 2)
        sizes = rng.integers(0, 30, 8)
        scores = rng.normal(size=(sizes.sum(), 3)) * 2 + np.array([rng.choice([0, 6]), 0, 0])
        text = np.repeat(np.arange(8), sizes)
        got = field.decode(scores, text)
        for t in range(8):
            assert got[text == t].tolist() == _whole_viterbi(field, scores[text == t]), trial


def test_fit_matches_the_likelihood_of_all_labellings():
    """On one short sequence the expected counts of forward-backward are those over all 27 labellings: the fit reaches the gold labels."""
    windows = np.arange(6).reshape(2, 3, 1)
    tags, valid = np.array([[0, 1, 2], [1, 0, 0]]), np.array([[True] * 3, [True, True, False]])
    field = secrets.fit_field(windows, tags, valid, rounds=200)
    scores = field.scores(np.arange(3).reshape(3, 1))
    best = max(itertools.product(range(3), repeat=3), key=lambda y: sum(scores[i, y[i]] for i in range(3)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
    assert best == (0, 1, 2)


def test_field_adds_spans_like_those_it_learned():
    field = secrets.learn(_texts(1, 400))
    text = "the Word token = zz" + "0123abcXYZ9" * 3 + " of mail"
    assert secrets.learn(["plain words only"]) is None
    # The value of an assignment by another word is no base span; the field finds it.
    other = 'value of config = "' + "9f8aX1b7c2dY3e4f5a6b7c8d9eZ0" + '" the mail'
    spans = secrets.added_spans([text, other, ""], [secrets.base_spans(text), secrets.base_spans(other), []], field)
    assert all(s[1] == 3 for own in spans for s in own) and spans[2] == []
    assert [other[a:b] for a, _, b in spans[1]] == ["9f8aX1b7c2dY3e4f5a6b7c8d9eZ0"]
    plain = _texts(7, 60)
    found = secrets.added_spans(plain, [secrets.base_spans(t) for t in plain], field)
    assert sum(len(s) for i, s in enumerate(found) if i % 3) == 0     # texts without a secret stay clean
    # Texts are tagged alike whatever else is in the batch.
    alone = [secrets.added_spans([t], [secrets.base_spans(t)], field)[0] for t in plain]
    assert alone == found


def test_scan_of_special_rows(spark):
    texts = _texts(3, 90)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", None), (0, texts[0], "x"), (None, texts[3], "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    field = secrets.fit(table)
    found = secrets.scan(table, field, ["doc_id"]).collect()
    assert len(found) == len(rows)
    for r in found:
        base = secrets.base_spans(dict((a, b) for a, b, _ in rows)[r.doc_id] or "")
        assert r.n_assign == sum(k == 0 for _, k, _, _ in base) and r.n_hex == sum(k == 2 for _, k, _, _ in base)
        assert r.base == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
        assert set(r.base.split(",")) <= set(r.spans.split(","))
    empty = table.limit(0)
    assert secrets.fit(empty) is None and secrets.scan(empty, None, ["doc_id"]).collect() == []
    assert secrets.scan(table, None, ["doc_id"]).filter("base <> spans").count() == 0


def test_sample_finds_few_secrets_among_many_texts(spark):
    """Texts with a base span are half of the sample, or all there are; the pattern of the draw agrees with the base spans."""
    secret = [f'note {i} api-less token = "{"0123456789abcdefXYZ"[i % 7:]}{i:09d}" end' for i in range(5)]
    rows = [(i, secret[i // 1000] if i % 1000 == 7 else f"plain words {i}") for i in range(5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = [r.text for r in secrets.training_sample(table, rows=400).collect()]
    assert sorted(t for t in drawn if secrets.base_spans(t)) == sorted(secret) and 150 <= len(drawn) - 5 <= 200
    assert secrets.fit(table, rows=400) is not None
    texts = _texts(5, 200) + secret + ["Passwd:'abcdefghijkl", "token=short", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "a" * 15, "é API_KEY = abcdefghijkl", "paſſword=abcdefghijkl",
                                      "token=token=abcdefghijklm", "f" * 16, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r.m for r in table.select(secrets.F.col("text").rlike(secrets.HOLDS_SECRET).alias("m")).collect()]
    assert found == [bool(secrets.base_spans(t)) for t in texts]
