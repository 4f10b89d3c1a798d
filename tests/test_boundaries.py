import math
import random

import pytest
from pyspark.sql import functions as F

from plateview.operators import absa, aspects, boundaries


@pytest.fixture(scope="module")
def reviews(spark):
    """Plain prose in which every noun stands inside and at the end of sentences, and abbreviations always have their period."""
    rng = random.Random(2)
    nouns = ["tea", "soup", "staff", "menu", "table", "door", "bread", "price", "wine", "music", "plate", "fish"]
    rows = []
    for i in range(400):
        said = []
        for _ in range(rng.randint(2, 5)):
            a, b = rng.sample(nouns, 2)
            said.append(rng.choice([f"The {a} was near the {b}.", f"We liked the {a} and the {b}.", f"We saw Dr. Brown with {a} and {b}.",
                                    f"Mr. White came at {rng.randint(2, 9)} p.m. with {a}.", f"The {a}, e.g. the {b}, was fine!"]))
        rows.append((i, " ".join(said)))
    return spark.createDataFrame(rows, "review_id long, text string")


@pytest.fixture(scope="module")
def model(reviews):
    return boundaries.fit(reviews)


def test_abbreviations_and_starters(model):
    assert {r.type for r in model.abbreviations.collect()} == {"dr", "mr", "p.m", "e.g"}
    assert {r.type for r in model.starters.collect()} >= {"the", "we"}


def _split(spark, model, *texts):
    table = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    return [r.sentences for r in boundaries.learned_sentences(table, model).orderBy("review_id").collect()]


def test_sentences(spark, model):
    found = _split(
        spark, model, "Dr. X paid 5 p.m. for tea.", "We met Dr. Brown at 5 p.m. The tea was good.", "Mr. White left. he came back, e.g. for wine! Really?",
        'They said "stop." Then we left.', "Wait... what? J. Brown had No. 5. It was 3.50. we paid", None, "", "   ", "no mark", "5. 6. End", "<b>Hi.</b> You")
    assert found == [
        ["Dr. X paid 5 p.m. for tea."], ["We met Dr. Brown at 5 p.m.", "The tea was good."], ["Mr. White left.", "he came back, e.g. for wine!", "Really?"],
        ['They said "stop."', "Then we left."], ["Wait... what?", "J. Brown had No.", "5.", "It was 3.50. we paid"], None, [], [], ["no mark"],
        ["5.", "6.", "End"], ["Hi.", "You"]]


def test_nothing_learned_is_the_plain_rule_for_words(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "review_id long, text string")
    model = boundaries.fit(empty)
    assert model.abbreviations.count() == model.starters.count() == 0
    assert _split(spark, model, "Dr. X came. He left.") == [["Dr.", "X came.", "He left."]]


def test_ratio_by_hand(spark):
    counts = spark.createDataFrame([("dr", 9, 1), ("tea", 1, 89)], "type string, n_period long, n_plain long")
    found = {r.type: r for r in boundaries.abbreviation_scores(counts).collect()}
    ratio = 2 * (9 * math.log(0.99) + math.log(0.01) - 9 * math.log(0.1) - math.log(0.9))
    assert found["dr"].ratio == pytest.approx(ratio) and found["dr"].score == pytest.approx(ratio * math.exp(-2) / 2)
    assert found["tea"].ratio < 0


def test_evidence_uses_learned_sentences(spark, model, scorer):
    table = spark.createDataFrame([(1, "Dr. Brown praised the food. The staff was slow.")], "review_id long, text string")
    lexicon = aspects.lexicon_table(spark)
    plain = {r.aspect: r.evidence for r in absa.analyze_reviews(table, lexicon, scorer).collect()}
    learned = {r.aspect: r.evidence for r in absa.analyze_reviews(table, lexicon, scorer, boundaries=model).collect()}
    assert plain["food"] == ["Brown praised the food."] and learned["food"] == ["Dr. Brown praised the food."]
    assert plain["service"] == learned["service"] == ["The staff was slow."]


def test_too_many_abbreviations_fail(spark, model):
    table = spark.createDataFrame([(1, "Dr. X came.")], "review_id long, cleaned string")
    with pytest.raises(Exception, match="abbreviations: more than 2 rows"):
        boundaries.with_sentences(table, model, ["review_id"], max_abbreviations=2).select(F.size("sentences")).collect()


def test_the_texts_are_read_once(spark, reviews):
    passed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        passed.add(1)
        return text

    learned = boundaries.fit(reviews.select("review_id", counted("text").alias("text")))
    assert passed.value == reviews.count()
    assert {r.type for r in learned.abbreviations.collect()} == {"dr", "mr", "p.m", "e.g"}


def test_counts_by_hand(spark):
    table = spark.createDataFrame([(1, 'Dr. Tea ran. "Soup fell!" Tea ran (it ran.) Soup 5! Tea J. Soup'), (2, None), (3, ""), (4, "tea... Soup ran")],
                                  "review_id long, text string")
    known = spark.createDataFrame([("dr",)], "type string")
    periods = {r.type: (r.n_period, r.n_plain) for r in boundaries.period_counts(table).collect()}
    assert periods == {"dr": (1, 0), "tea": (0, 4), "ran": (2, 2), "soup": (0, 4), "fell": (0, 1), "it": (0, 1), "j": (1, 0)}
    starts = {r.type: (r.n_after, r.n) for r in boundaries.starter_counts(table, known).collect()}
    assert starts == {"dr": (0, 1), "tea": (2, 4), "ran": (0, 4), "soup": (2, 4), "fell": (0, 1), "it": (0, 1), "j": (0, 1)}
