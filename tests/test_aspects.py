import pytest
from pyspark.errors import PySparkException

from plateview.operators import aspects, word_vectors
from plateview.operators import terms as tm
from plateview.operators.joins import bounded, lookup_join
from plateview.schemas import DEFAULT_ASPECTS, DEFAULT_SYNONYMS
from pyspark.sql import functions as F

VECTORS = [("food", [1.0, 0.0, 0.0]), ("service", [0.0, 1.0, 0.0]), ("pasta", [0.9, 0.1, 0.0]), ("zero", [0.0, 0.0, 0.0]),
           ("even", [1.0, 1.0, 0.0]), ("half", [0.5, 0.0, 0.75 ** 0.5]), ("far", [0.0, 0.0, 1.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "token string, vec array<float>")


def reviews(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")


def forms(detected):
    return {(r["review_id"], r["aspect"]): r["forms"] for r in aspects.surface_forms(detected).collect()}


def test_every_default_aspect_is_its_own_synonym():
    assert len(set(DEFAULT_ASPECTS)) == len(DEFAULT_ASPECTS)
    assert all(a in DEFAULT_SYNONYMS[a] for a in DEFAULT_ASPECTS) and set(DEFAULT_SYNONYMS) == set(DEFAULT_ASPECTS)


def test_synonyms_in_row(spark):
    table = reviews(spark, "The staff and our waiter were kind. Great menu!", "Nothing here.", "  ", None)
    found = forms(aspects.extract_aspects(table, aspects.lexicon_table(spark)))
    assert found == {(0, "service"): ["staff", "waiter"], (0, "menu"): ["menu"]}


def test_excluded_aspect_does_not_break_extraction(spark):
    found = forms(aspects.extract_aspects(reviews(spark, "Good food, slow waiter"), aspects.lexicon_table(spark, ["food"])))
    assert found == {(0, "food"): ["food"]}


def test_a_term_listed_twice_goes_to_the_later_aspect(spark):
    both = aspects.lexicon_table(spark, ["a", "b"], {"a": ["x"], "b": ["x", "y"]})
    assert {(r["term"], r["aspect"]) for r in both.collect()} == {("x", "b"), ("y", "b")}


def test_vector_path_end_to_end(spark, vectors):
    lexicon = aspects.lexicon_table(spark, ["food", "service"])
    table = reviews(spark, "Our waiter spilled soup; still, we liked the pasta.")
    found = forms(aspects.extract_aspects(table, lexicon, vectors=vectors))
    assert found[0, "service"] == ["waiter"] and "pasta" in found[0, "food"]


def test_threshold_tie_zero_and_unknown(spark, vectors):
    lexicon = aspects.lexicon_table(spark, ["food", "service"])
    terms = spark.createDataFrame([(t,) for t in ["pasta", "zero", "even", "half", "far", "unknown", "food", "pasta unknown"]], "term string")
    got = {r["term"]: (r["aspect"], r["score"]) for r in aspects.match_terms(terms, lexicon, vectors).collect()}
    assert got["food"] == ("food", 1.0)
    assert got["even"][0] == "food"  # equal scores: the earlier aspect
    assert got["half"] == ("food", pytest.approx(0.5))  # exactly at the threshold
    assert got["pasta unknown"][1] == pytest.approx(got["pasta"][1])  # unknown words do not turn the mean
    assert not {"zero", "far", "unknown"} & set(got)


def test_sweep_counts_every_threshold(spark):
    scored = spark.createDataFrame([("a", 0.3), ("a", 0.6), ("b", 0.9)], "aspect string, score double")
    got = {(r["threshold"], r["aspect"]): r["n_terms"] for r in aspects.threshold_sweep(scored, [0.3, 0.6, 0.95]).collect()}
    assert got == {(0.3, "a"): 2, (0.3, "b"): 1, (0.6, "a"): 1, (0.6, "b"): 1}


def test_lemmas_and_raw_forms(spark):
    words = spark.createDataFrame([(w,) for w in ["waiters", "waiter", "dishes", "dish", "parties", "party", "glass", "glas", "menus"]], "token string")
    lemmas = tm.plural_lemmas(words)
    assert {(r["token"], r["lemma"]) for r in lemmas.collect()} == {("waiters", "waiter"), ("dishes", "dish"), ("parties", "party")}
    found = forms(aspects.extract_aspects(reviews(spark, "Rude waiters."), aspects.lexicon_table(spark), lemmas=lemmas))
    assert found == {(0, "service"): ["waiter", "waiters"]}


def test_nouns_restrict_candidates(spark):
    nouns = spark.createDataFrame([("waiter",)], "token string")
    found = forms(aspects.extract_aspects(reviews(spark, "The waiter brought clean food"), aspects.lexicon_table(spark), nouns=nouns))
    assert found == {(0, "service"): ["waiter"]}


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        tm.prepare(reviews(spark, "x"), mode="verbs")


def test_bounded_tables(spark):
    table = spark.range(5).withColumn("other", F.col("id") * 2)
    assert bounded(table, 5, "ids").count() == 5
    for few in (bounded(table, 4, "ids"), bounded(table, 4, "ids").select("other"), bounded(table, 4, "ids").groupBy().count()):
        with pytest.raises(PySparkException, match="more than 4 rows"):
            few.collect()


def test_lexicon_phrases_of_any_length_and_words(spark):
    lexicon = aspects.lexicon_table(spark, ["price", "food", "seat"], {
        "price": ["value for money", "2 for 1"], "food": ["slow cooked wild boar", "pasta"], "seat": ["table 9"]})
    table = reviews(spark, "Good value for money, and the slow cooked wild boar!", "Table 9, pasta. 2 for 1 today", "value. for money", "table 9")
    expected = {(0, "price"): ["value for money"], (0, "food"): ["slow cooked wild boar"], (1, "seat"): ["table 9"],
                (1, "food"): ["pasta"], (1, "price"): ["2 for 1"], (3, "seat"): ["table 9"]}
    assert forms(aspects.extract_aspects(table, lexicon)) == expected
    lemmas = spark.createDataFrame([("boars", "boar")], "token string, lemma string")
    assert forms(aspects.extract_aspects(table, lexicon, lemmas=lemmas)) == expected


def test_a_large_lexicon_matches_like_a_small_one(spark, monkeypatch):
    owned = {"a": [f"word{i}" for i in range(3000)] + ["two words"], "b": [f"other{i}" for i in range(3000)] + ["and"]}
    words = ["word7", "nothing", "other2999", "two words and", "word2999"]
    # Letters and digits stand together in one token.
    lexicon = aspects.lexicon_table(spark, ["a", "b"], owned)
    table = reviews(spark, *words, None)
    small = forms(aspects.extract_aspects(table, lexicon))
    monkeypatch.setattr(aspects, "MAX_INROW_LEXICON", 10)
    large = forms(aspects.extract_aspects(table, lexicon))
    assert small == large == {(0, "a"): ["word7"], (2, "b"): ["other2999"], (3, "a"): ["two words"], (3, "b"): ["and"], (4, "a"): ["word2999"]}


def test_own_candidates(spark, vectors):
    own = spark.createDataFrame([(0, "pasta"), (0, "far")], "review_id long, term string")
    lexicon = aspects.lexicon_table(spark, ["food", "service"])
    found = forms(aspects.extract_aspects(reviews(spark, "The spaghetti"), lexicon, vectors=vectors, candidates=own))
    assert found == {(0, "food"): ["pasta"]}


def test_vectors_from_the_corpus(spark):
    good = ["the soup tasted warm and rich", "the stew tasted warm and rich", "the broth tasted warm and rich"] * 30
    other = ["our guide walked up north quickly", "our driver walked up north quickly"] * 30
    learned = word_vectors.corpus_vectors(reviews(spark, *good, *other, " ", None), size=8, min_count=3, epochs=3)
    assert {"soup", "stew", "driver"} <= {r["token"] for r in learned.collect()} and len(learned.first()["vec"]) == 8
    lexicon = aspects.lexicon_table(spark, ["soup"], {"soup": ["soup"]})
    found = forms(aspects.extract_aspects(reviews(spark, "soup and stew"), lexicon, vectors=learned, threshold=-1.0, mode="nouns"))
    assert set(found[0, "soup"]) >= {"soup", "stew"}


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_broadcast_and_shuffled_lookups_agree(spark, how):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3)], "k string, v int")
    small = lookup_join(facts, F.broadcast(lookup), ["k"], how)
    large = lookup_join(facts, lookup.hint("merge"), ["k"], how)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))


def test_full_extraction_reads_the_texts_twice(spark):
    """Once for the candidates and once to meet the aspects, with lemmas and a lexicon whose terms are no candidates."""
    passed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        passed.add(1)
        return text

    rows = [(1, "The dishes were cold. Not 24 hours open."), (2, "Nothing here"), (3, None), (4, "dish 24 dish")]
    reviews = spark.createDataFrame(rows, "review_id long, text string").select("review_id", counted("text").alias("text"))
    lexicon = spark.createDataFrame([("dish", "food", 0), ("24", "hours", 1)], "term string, aspect string, ord int")
    known = spark.createDataFrame([("dishes", "dish")], "token string, lemma string")
    found = aspects.surface_forms(aspects.extract_aspects(reviews, lexicon, mode="nouns", lemmas=known)).collect()
    assert {(r.review_id, r.aspect): r.forms for r in found} == {(1, "food"): ["dish", "dishes"], (1, "hours"): ["24"], (4, "food"): ["dish"], (4, "hours"): ["24"]}
    assert passed.value <= 2 * len(rows)
