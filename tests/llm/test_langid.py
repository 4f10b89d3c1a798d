import random

import numpy as np
from pyspark.sql import functions as F

from plateview.llm import langid


def _texts(seed, n):
    rng = random.Random(seed)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "oux", "ment", "ét"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 30))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_special_texts(spark):
    rows = _texts(1, 300) + [(900, None, "aa"), (901, "", "bb"), (902, "123 !! 45", "cc"), (903, "kato", None), (None, "einung verschung", None)]
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(table.filter(~langid.held_out(F.col("doc_id"))))
    assert model.languages == ["aa", "bb", "cc"] and 0.04 < model.temperature < 21
    assert (model.weights == 0).mean() > 0.9     # the penalty leaves most features without weight
    found = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert all(found[i].lang_pred == lang for i, t, lang in rows[:300])
    assert all(found[i].lang_pred == "und" and found[i].score == 0.0 for i in (900, 901, 902))
    assert found[903].lang_pred == "aa" and found[None].lang_pred == "bb"
    assert all(0.0 <= r.score <= 1.0 for r in found.values())


def test_held_out_rule(spark):
    import zlib
    ids = list(range(50)) + [None]
    table = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", langid.held_out(F.col("doc_id")).alias("h"))
    assert {r.doc_id: r.h for r in table.collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert [tuple(r)[1:] for r in langid.identify(table, model, ["doc_id"]).collect()] == [("und", 0.0)]
    empty = table.limit(0)
    assert langid.identify(empty, langid.fit(empty)).collect() == []


def test_sample_is_bounded_and_balanced(spark):
    rows = [(f"text {i}", "big") for i in range(500)] + [(f"other {i}", "small") for i in range(40)]
    counts = langid._sample(spark.createDataFrame(rows, "text string, lang string"), "lang", "text", 60).groupBy("lang").count().collect()
    counts = {r.lang: r["count"] for r in counts}
    assert counts["big"] <= 30 and counts["small"] <= 30 and counts["small"] > 20


def test_features_count_grams_of_letters():
    found, counts = langid.features("Ab  1b")
    again, _ = langid.features("ab-B")
    assert counts.sum() == 6 + 5 + 4 and (found == again).all()     # " ab b " has 6, 5 and 4 grams
    assert len(langid.features("12 \n")[0]) == 0


def test_temperature_makes_confidence_match():
    rng = np.random.default_rng(1)
    true = rng.normal(size=(4000, 3))
    share = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=p) for p in share])
    assert abs(langid._temperature(true * 5, labels) - 5) < 0.6
