import pytest
from pyspark.sql import functions as F

from plateview.functions import text as tx
from plateview.functions import vectors as vx


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, cleaned", [
    ("It wasn't bad, and the soup was hot!", "It wasn't bad, and the soup was hot!"),
    ("Nice <b>spot</b> https://example.org/a?b=1 !", "Nice spot !"),
    ("www.example.org is down\x0b\x1cnow", "is down now"),
    ("ask @someone_1 or @café now", "ask or now"),
    ("mail a@b.com", "mail a .com"),
    ("it wasn’t", "it wasn t"),
    ("a <b unclosed tag", "a <b unclosed tag"),
    ("see http://x.y/ after", "see after"),
    ("   \t\n", ""),
    ("", ""),
    (None, None),
])
def test_light_clean(spark, raw, cleaned):
    assert one(spark, raw, tx.light_clean) == cleaned


def test_quotes_can_be_kept(spark):
    assert one(spark, "it wasn’t", lambda t: tx.light_clean(t, normalize_quotes=True)) == "it wasn't"


@pytest.mark.parametrize("raw, cleaned", [
    ("The soup wasn't HOT.", "the soup wasn t hot"),
    ("write to a.b@c.com today", "write to today"),
    ("5* @home_x yes", "5 yes"),
    (None, None),
])
def test_aggressive_clean(spark, raw, cleaned):
    assert one(spark, raw, tx.aggressive_clean) == cleaned


def test_classical_clean(spark):
    assert one(spark, "The 2 Dishes weren't good", lambda t: tx.classical_clean(t)) == "the dishes weren t good"
    assert one(spark, "The 2 Dishes weren't good", lambda t: tx.classical_clean(t, ["the", "t"])) == "dishes weren good"


@pytest.mark.parametrize("text, expected", [
    ("The soup was hot. The bread was stale.", ["The soup was hot.", "The bread was stale."]),
    ("One! Two?  Three... four", ["One!", "Two?", "Three...", "four"]),
    ("No gap.Here", ["No gap.Here"]),
    ("", []),
    (None, None),
])
def test_sentences(spark, text, expected):
    assert one(spark, text, tx.split_sentences) == expected


def test_phrases_stop_at_stop_words_numbers_and_punctuation(spark):
    table = spark.createDataFrame([("The chef's wait time, and 2 slow waiters",)], "t string")
    masked = table.select(tx.content_words(F.col("t")).alias("m"))
    found = masked.select(tx.phrase_terms(F.col("m")).alias("p"), tx.single_terms(F.col("m")).alias("s")).first()
    assert set(found["p"]) == {"chef", "wait", "time", "chef wait", "wait time", "chef wait time", "slow", "waiters", "slow waiters"}
    assert found["s"] == ["chef", "wait", "time", "slow", "waiters"]


def test_mentions_are_substrings_unless_word_boundary(spark):
    table = spark.createDataFrame([(["The COST is high.", "Nice costume."], ["cost"])], "s array<string>, f array<string>")
    row = table.select(tx.sentences_mentioning(F.col("s"), F.col("f")).alias("a"),
                       tx.sentences_mentioning(F.col("s"), F.col("f"), word_boundary=True).alias("b")).first()
    assert row["a"] == ["The COST is high.", "Nice costume."]
    assert row["b"] == ["The COST is high."]


def test_run_counts(spark):
    table = spark.createDataFrame([(["a", "a", "b", "c", "c", "c"],), ([],)], "s array<string>")
    rows = table.withColumn("st", tx.run_starts("s")).select(tx.run_counts("s", "st").alias("r")).collect()
    assert [tuple(x) for x in rows[0]["r"]] == [("a", 2), ("b", 1), ("c", 3)]
    assert not rows[1]["r"]


def test_softmax_and_argmax(spark):
    row = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "z array<double>").select(
        vx.softmax(F.col("z")).alias("p"), vx.argmax(F.col("z")).alias("i")).first()
    assert row["p"] == pytest.approx([0.5, 0.5, 0.0]) and row["i"] == 0
    assert sum(row["p"]) == pytest.approx(1.0)


def test_light_clean_is_its_four_patterns(spark):
    texts = ["a <b>c</b> d", "x @né漢y z", "see https://a.b/é c and www.q.de\x1fend", "\x0b a\x1c\x1d b \t\r\n", "\x00 a \x7f b", "é", "", " ", None,
             "a b c\x85d", "x😀😀y", "plain  words", "a < b", "@ @@ http: www"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    table = table.union(spark.range(1).selectExpr("100", "cast(unhex('61ff6220c363') as string)"))
    column = F.col("text")
    for pattern in (tx.HTML_TAG, tx.URL, tx.MENTION, tx.NON_ASCII):
        column = F.regexp_replace(column, pattern, " ")
    found = table.select("i", tx.light_clean(F.col("text")).alias("got"), tx.squeeze(column).alias("want")).collect()
    assert len(found) == len(texts) + 1 and [r.got for r in found] == [r.want for r in found]
