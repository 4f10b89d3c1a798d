import math
import random

import pytest
from pyspark.sql import functions as F

from plateview.operators import absa, aspects, metrics, scoring, timing

TEXTS = [
    "The food was delicious. The service was terribly slow! Lovely atmosphere.",
    "We sat outside.",
    "Great food but slow service.",
    "Rude staff.",
    None,
]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "review_id long, text string")


@pytest.fixture(scope="module")
def lexicon(spark):
    return aspects.lexicon_table(spark)


@pytest.fixture(scope="module")
def results(spark, reviews, lexicon, scorer):
    return absa.analyze_reviews(reviews, lexicon, scorer).cache()


def test_each_aspect_is_judged_by_its_own_sentence(results):
    got = {(r["review_id"], r["aspect"]): r for r in results.collect()}
    assert set(got) == {(0, "food"), (0, "service"), (0, "ambience"), (2, "food"), (2, "service"), (3, "service")}
    assert got[0, "food"]["label"] == "Positive" and got[0, "service"]["label"] == "Negative"
    assert got[0, "service"]["evidence"] == ["The service was terribly slow!"] and got[0, "service"]["n_evidence"] == 1
    assert all(1 / 3 <= r["confidence"] <= 1 for r in got.values())


def test_two_aspects_in_one_sentence_get_their_own_label(results):
    got = {r["aspect"]: r["label"] for r in results.filter("review_id = 2").collect()}
    assert got == {"food": "Positive", "service": "Negative"}


def test_context_modes(spark, reviews, lexicon):
    detected = aspects.extract_aspects(reviews, lexicon)
    full = absa.contexts(detected, absa.FULL_REVIEW).filter("review_id = 0").collect()
    assert all(r["context"] == TEXTS[0] and len(r["evidence"]) == 3 for r in full)
    with pytest.raises(ValueError):
        absa.contexts(detected, "paragraph")


def test_weights_looked_up_or_joined_give_the_same(reviews, lexicon, scorer, results, monkeypatch):
    monkeypatch.setattr(scoring, "MAX_INROW_BYTES", -1)
    joined = absa.analyze_reviews(reviews, lexicon, scorer)
    assert sorted(map(repr, joined.select(results.columns).collect())) == sorted(map(repr, results.collect()))


@pytest.mark.parametrize("limit", [1 << 30, -1])
@pytest.mark.parametrize("mode", [absa.SENTENCE, absa.FULL_REVIEW])
def test_one_lookup_per_review_equals_a_lookup_per_context(spark, lexicon, scorer, mode, limit, monkeypatch):
    """Contexts of sentences that are not neighbours hold bigrams that the review does not."""
    monkeypatch.setattr(scoring, "MAX_INROW_BYTES", limit)
    texts = ["Great food. We sat outside. Delicious food was slow. Rude! The food", "The service was slow. A. Terribly. Slow service. staff great",
             "food", "Service. . Food? great staff and tasty food! lovely. cold", "", None]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    detected = aspects.extract_aspects(reviews, lexicon)
    each = absa.score_contexts(absa.contexts(detected, mode), scorer)
    once = absa.score_detected(detected, scorer, [mode]).select(each.columns)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, each.collect()))


def test_no_sentence_mentions_the_form_falls_back_to_all(spark):
    detected = spark.createDataFrame([(1, "One. Two.", ["One.", "Two."], [(0, "food", ["pasta"])])],
                                     "review_id long, cleaned string, sentences array<string>, detected array<struct<ord:int,aspect:string,forms:array<string>>>")
    row = absa.contexts(detected).first()
    assert row["evidence"] == ["One.", "Two."] and row["context"] == "One. Two."


def test_evidence_and_aspects_are_subsets(results, reviews):
    for row in results.join(reviews, "review_id").collect():
        assert set(row["evidence"]) <= {s.strip() for s in row["text"].replace("!", "!|").replace(".", ".|").split("|")}


def test_order_of_the_input_does_not_matter(reviews, lexicon, scorer, results):
    again = absa.analyze_reviews(reviews.repartition(7, F.rand(1)), lexicon, scorer)
    assert sorted(map(repr, again.select(results.columns).collect())) == sorted(map(repr, results.collect()))


def test_formatting(spark, reviews):
    rows = [(0, 0, "food", "Positive", 0.9), (0, 2, "ambience", "Negative", 0.75)]
    shown = absa.format_results(spark.createDataFrame(rows, "review_id long, ord int, aspect string, label string, confidence double"), reviews)
    got = {r["review_id"]: r["report"] for r in shown.collect()}
    assert got[0] == "Food     -> Positive (0.9)\nAmbience -> Negative (0.75)"
    assert got[1] == "No aspects detected in this review." and len(got) == 5


def test_qualitative_joins_evidence(spark):
    rows = [(0, "food", "Positive", 0.9, ["A.", "B."])]
    table = absa.qualitative(spark.createDataFrame(rows, "review_id long, aspect string, label string, confidence double, evidence array<string>"))
    assert table.first()["evidence"] == "A. | B."


def test_one_pass_comparison_equals_two_analyses(reviews, lexicon, scorer, results):
    quick = absa.compare_context_modes(reviews, lexicon, scorer)
    full = absa.analyze_reviews(reviews, lexicon, scorer, absa.FULL_REVIEW, with_evidence=False)
    slow = absa.compare_results(full, results, "full_review", "sentence")
    assert sorted(map(repr, quick.collect())) == sorted(map(repr, slow.select(quick.columns).collect()))


def test_agreement_is_unknown_if_one_side_lacks_the_aspect(spark):
    def side(*rows):
        return spark.createDataFrame(list(rows), "review_id long, aspect string, label string, confidence double")
    got = {r["aspect"]: r["agree"] for r in absa.compare_results(
        side((1, "a", "P", 0.5), (1, "b", "P", 0.5)), side((1, "b", "N", 0.5), (1, "c", "P", 0.5)), "l", "r").collect()}
    assert got == {"a": None, "b": False, "c": None}


def test_gold_rows_need_not_be_adjacent(spark, lexicon, scorer):
    gold = spark.createDataFrame([
        (TEXTS[0], "food", "Positive"), (TEXTS[3], "service", "Negative"), (TEXTS[0], "service", "Negative"), (TEXTS[0], "menu", "Neutral"),
    ], "review string, aspect string, true_label string")
    results = absa.analyze_reviews(absa.gold_reviews(gold), lexicon, scorer, with_evidence=False)
    judged = absa.score_against_gold(gold, results)
    head = judged["headline"].first()
    assert head["n"] == 4 and head["accuracy"] == 0.75
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in judged["confusion"].collect() if r["n"]}
    assert cells == {("Positive", "Positive"): 1, ("Negative", "Negative"): 2, ("Neutral", "NotDetected"): 1}


def brute_grams(tokens, form_words):
    at = [i for i, t in enumerate(tokens) if t in form_words]
    weight = [1 / (1 + min(abs(i - m) for m in at)) if at else 1.0 for i in range(len(tokens))]
    singles = [(t, w) for t, w in zip(tokens, weight)]
    pairs = [(f"{a} {b}", w) for a, b, w in zip(tokens, tokens[1:], weight)]
    return sorted(singles + pairs)


CASES = [
    ("the food here and the food there with slow service at the end food", ["food"]),
    ("good wait time and more time to wait", ["wait time"]),
    ("nothing of that kind", ["food"]), ("food", ["food"]), ("", ["food"]), ("aa bb cc dd", []), (None, ["food"]),
]


@pytest.mark.parametrize("limit", [1 << 30, -1])
def test_distance_weights_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(scoring, "MAX_INROW_BYTES", limit)
    rng = random.Random(1)
    words = sorted({w for c, _ in CASES for w in (c or "").split()})
    terms = words[::2] + [f"{a} {b}" for a, b in zip(words, words[1:])] + ["the food", "food there", "aa bb", "wait time"]
    lw = {t: (-rng.random() * 5, -rng.random() * 5) for t in terms}
    weights = spark.createDataFrame([(t, 1, *v) for t, v in lw.items()], "term string, tf long, lw_0 double, lw_1 double")
    priors = spark.createDataFrame([(-0.3, -1.3)], "prior_0 double, prior_1 double")
    scorer = scoring.BayesScorer(weights, priors, [0, 1], ["bad", "good"]).materialised()
    table = spark.createDataFrame([(i, c, f, [{"k": str(i)}]) for i, (c, f) in enumerate(CASES)],
                                  "id long, context string, forms array<string>, taken array<map<string,string>>")
    got = {r["id"]: r for r in scorer.score(table, ["id"], ["taken"]).collect()}
    for i, (context, forms) in enumerate(CASES):
        tokens = [t for t in (context or "").split() if len(t) > 1]
        known = [(lw[t], w) for t, w in brute_grams(tokens, {w for f in forms for w in f.split()}) if t in lw]
        total = 1 + sum(w for _, w in known)
        z = [(p + sum(w * v[k] for v, w in known)) / total for k, p in enumerate((-0.3, -1.3))]
        assert got[i]["class_id"] == z.index(max(z)) and got[i]["taken"] == [{"k": str(i)}]
        assert got[i]["confidence"] == pytest.approx(1 / (1 + math.exp(min(z) - max(z))), abs=1e-4)


def test_scorer_of_many_terms_carries_anything(spark):
    """60,000 weights and an array to take along."""
    weights = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"), F.lit(1).alias("tf"),
                                         F.when(F.col("id") % 2 == 0, -1.0).otherwise(-3.0).alias("lw_0"), F.lit(-2.0).alias("lw_1"))
    priors = spark.createDataFrame([(-0.7, -0.7)], "prior_0 double, prior_1 double")
    scorer = scoring.BayesScorer(weights, priors, [0, 1], ["even", "odd"]).materialised()
    table = spark.createDataFrame([(0, "w59998 w2", ["x"]), (1, "w59999 w3", ["y", "z"])], "id long, context string, evidence array<string>")
    rows = scorer.score(table.withColumn("forms", F.array().cast("array<string>")), ["id"], ["evidence"]).orderBy("id").collect()
    assert [(r["label"], r["evidence"]) for r in rows] == [("Even", ["x"]), ("Odd", ["y", "z"])]


def test_all_terms_have_weights_unless_a_size_is_given(spark):
    texts = spark.createDataFrame([(1, "aa bb", 0), (2, "aa cc", 1)], "review_id long, Review string, label int")
    assert {r["term"] for r in scoring.bayes_weights(texts, "Review", "label", [0, 1]).collect()} == {"aa", "bb", "cc", "aa bb", "aa cc"}
    assert {r["term"] for r in scoring.bayes_weights(texts, "Review", "label", [0, 1], 1).collect()} == {"aa"}


def keyword_model():
    # Nested functions travel to the workers by value.
    def make_predict():
        import numpy as np

        def predict(contexts, names):
            return np.array([[float("slow" in c), 0.0, float("great" in c.lower())] for c in contexts], dtype="float32")
        return predict
    return make_predict


@pytest.mark.parametrize("distinct", [True, False])
def test_batch_model(spark, reviews, lexicon, distinct):
    scorer = scoring.BatchScorer(keyword_model(), ["negative", "neutral", "positive"], distinct_pairs=distinct)
    copies = reviews.unionByName(reviews.select((F.col("review_id") + 10).alias("review_id"), "text"))
    got = {(r["review_id"], r["aspect"]): r["label"] for r in absa.analyze_reviews(copies, lexicon, scorer).collect()}
    assert got[0, "service"] == got[10, "service"] == "Negative" and len(got) == 12
    # A tie of all logits goes to the first class.
    assert got[3, "service"] == "Negative"


def test_timed_runs(spark, reviews, lexicon, scorer):
    jobs = {"analyze": lambda: absa.analyze_reviews(reviews, lexicon, scorer, with_evidence=False), "read": lambda: reviews}
    rows = timing.timed_runs(spark, jobs, [reviews], repeats=2).collect()
    assert [(r["job"], r["run"], r["rows"]) for r in rows] == [("analyze", 0, 6), ("analyze", 1, 6), ("read", 0, 5), ("read", 1, 5)]
    assert all(r["seconds"] > 0 and r["rows_per_second"] == pytest.approx(r["rows"] / r["seconds"]) for r in rows)


def test_reviews_beside_results(spark, reviews, lexicon, scorer, results):
    shown = {r["review_id"]: r["review"] for r in absa.qualitative(results, reviews).collect()}
    assert shown == {i: TEXTS[i] for i in (0, 2, 3)}
    compared = absa.compare_context_modes(reviews, lexicon, scorer, with_review=True)
    assert {r["review_id"]: r["review"] for r in compared.collect()} == shown


def test_metrics_of_logits(spark):
    from plateview.functions import vectors as vx
    table = spark.createDataFrame([([0.1, 0.9], 1), ([0.5, 0.5], 0), ([0.2, 0.1], 1)], "z array<double>, y int")
    head = metrics.headline(metrics.pair_counts(table.withColumn("p", vx.argmax(F.col("z"))), "y", "p")).first()
    assert head["accuracy"] == pytest.approx(2 / 3)


def test_a_large_table_of_weights_gives_the_rows_of_a_small_one(spark, scorer, monkeypatch):
    """Blocks of texts meet their terms: bigrams across a gap, no mention, no context, repeated and missing keys, several passes."""
    said = ["The food was cold. We sat. Great tasty food!", "Service was slow and rude. Lovely atmosphere. The staff was friendly.", "", None, "Nothing here. Okay place."]
    rows = [(i if i % 5 else None, said[i % len(said)]) for i in range(40)] * 2
    reviews = spark.createDataFrame(rows, "review_id long, text string").select("review_id", F.split("text", r"\. ").alias("s"))
    marks = {"some": F.transform("s", lambda s, i: i % 2 == 0), "all": F.lit(None).cast("array<boolean>"), "short": F.array(F.lit(None).cast("boolean"), F.lit(True))}
    asks = [F.struct(F.lit(n).alias("n"), F.array(*[F.lit(f) for f in forms]).cast("array<string>").alias("forms"), which.alias("which"))
            for n, which in marks.items() for forms in (["food"], ["great service", "staff"], [])]
    table = reviews.select("review_id", F.transform("s", lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z]{2,}"), 0)).alias("_lists"), F.array(*asks).alias("_asks"))

    def scored():
        return sorted(map(repr, scorer.score_asks(table, ["review_id"], ["n"], []).select("review_id", "n", "class_id", "confidence").collect()))

    in_row = scored()
    assert len(in_row) == 9 * len(rows) and len(set(in_row)) > 20
    monkeypatch.setattr(scoring, "MAX_INROW_BYTES", -1)
    assert scored() == in_row
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 7)
    assert scored() == in_row


def test_copies_of_a_text_are_analysed_once(spark, lexicon, scorer):
    rows = [(i if i % 6 else None, TEXTS[i % 5] if i % 7 else None) for i in range(60)] * 2
    reviews = spark.createDataFrame(rows, "review_id long, text string")
    given = []

    def analyze(texts):
        given.append(texts.count())
        return absa.analyze_reviews(texts, lexicon, scorer)

    once = absa.once_per_text(reviews, analyze)
    each = absa.analyze_reviews(reviews, lexicon, scorer)
    assert once.columns == each.columns and given == [len({text for _, text in rows})]
    assert sorted(map(repr, once.collect())) == sorted(map(repr, each.collect()))


def test_copies_of_a_text_are_compared_once(spark, lexicon, scorer):
    subset = lexicon.filter("ord < 2")
    given = []

    def whole(texts):
        given.append(texts.count())
        return absa.analyze_reviews(texts, lexicon, scorer, with_evidence=False)

    def part(texts):
        return absa.analyze_reviews(texts, subset, scorer, absa.FULL_REVIEW, with_evidence=False)

    plain = [(i, TEXTS[i % 5] if i % 7 else None) for i in range(60)]
    rows = [*plain, *plain[10:20], (3, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[1]), (None, TEXTS[2])]
    reviews = spark.createDataFrame(rows, "review_id long, text string")
    found = absa.compared_once_per_text(reviews, whole, part, "whole", "part")
    each = absa.compare_results(whole(reviews), part(reviews), "whole", "part")
    assert found.columns == each.columns and given == [len({text for _, text in rows}), len(rows)]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, each.collect()))


def test_reviews_do_not_meet_their_two_results(spark, lexicon, scorer):
    reviews = spark.range(60).select(F.col("id").alias("review_id"), F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    analyze = lambda texts: absa.analyze_reviews(texts, lexicon, scorer, with_evidence=False)
    plan = absa.compared_once_per_text(reviews, analyze, analyze, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "FullOuter" not in plan


def test_hashes_of_texts_travel_as_sixteen_bytes(spark):
    gold = spark.createDataFrame([("Good food.", "food", "Positive"), (None, "food", "Neutral")] * 3, "review string, aspect string, true_label string")
    found = {r["text"]: r["review_id"] for r in absa.gold_reviews(gold).collect()}
    assert len(found) == 2 and len(found["Good food."]) == 16 and found[None] is None


def test_texts_travel_to_their_block_as_joined_tokens(spark, scorer, monkeypatch):
    kept = []
    monkeypatch.setattr(scoring, "MAX_INROW_BYTES", -1)
    monkeypatch.setattr(scoring, "stored", lambda table, name: kept.append(table) or table.localCheckpoint())
    table = spark.createDataFrame([(0, "great food", ["food"]), (1, "", []), (2, None, ["food"])], "id long, context string, forms array<string>")
    rows = scorer.score(table, ["id"]).orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2] and rows[0]["label"] == "Positive"
    assert [r["_lists"] for r in kept[0].orderBy("id").collect()] == [["great food"], [""], [None]]
