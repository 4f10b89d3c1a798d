"""Reviews, ratings and dictionaries derived by Spark from the given tables.

The tables hold no restaurant reviews, so queries use two kinds of review: the texts
as they are, with a lexicon drawn from their own vocabulary, and reviews rendered from the
attributes of each order, in which the default aspects occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plateview.functions import text as tx
from plateview.operators import terms as tm
from plateview.operators.splits import split_two_way
from plateview.operators.ratings import clean_ratings
from plateview.schemas import DEFAULT_ASPECTS
from plateview.sources.scratch import spread, stored

# Fixed values of the derived inputs.
LEXICON_SIZE = 21
LEXICON_MIN_LENGTH = 4
PHRASE_WORDS = 20
ORDER_BYTES = 2 << 20     # of the order columns in a partition; a rendered review is some ten times its order
SWEEP_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]

STATUS_SENTENCES = {
    "F": "The food was delicious and the taste was perfect.",
    "O": "The food was cold and the dish had no flavor.",
    "P": "The meal was okay, nothing special.",
}
PRIORITY_SENTENCES = {
    "1-URGENT": "Our waiter was rude and the service was terribly slow!",
    "2-HIGH": "Service was slow.",
    "3-MEDIUM": "The staff did their job.",
    "4-NOT SPECIFIED": "The waitress was friendly and attentive.",
    "5-LOW": "Great service, the staff could not have been nicer.",
}
DEAR_SENTENCE = "The price was far too high, we paid "
CHEAP_SENTENCE = "Good value for the money at "
SEASON_SENTENCES = [
    "Lovely atmosphere and decor.",
    "The ambience was loud, and the tables were not clean.",
    "The menu has many options! Portion size was generous.",
    "We sat by the window and talked.",
]
STATUS_STARS = {"F": 1.0, "O": -1.0, "P": 0.0}
PRIORITY_STARS = {"1-URGENT": -1.0, "2-HIGH": -0.5, "3-MEDIUM": 0.0, "4-NOT SPECIFIED": 0.5, "5-LOW": 1.0}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def document_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), "text"), "review_id")


def document_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``(review_id, Review, Rating)``: each document with the stars that its quality and toxicity labels suggest."""
    documents = spread(read(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars"), "doc_id")
    labels = read(spark, folder, "labels").select("doc_id", "quality", "toxic")
    stars = (F.when(F.col("quality").isNull(), F.when(F.col("lang") == "en", "Like"))
             .when((F.col("quality") == 0) & (F.col("toxic") == 1), "1")
             .when(F.col("quality") == 0, F.when(F.col("n_chars") % 2 == 0, "1.5").otherwise("2.5"))
             .when(F.col("toxic") == 1, "3")
             .otherwise(F.element_at(F.array(F.lit("3.5"), F.lit("4.5"), F.lit("5")), (F.col("n_chars") % 3 + 1).cast("int"))))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("Review"), stars.alias("Rating"))


def document_split(spark: SparkSession, folder: str) -> DataFrame:
    """``(review_id, Review, rating, label, split)``, cleaned and stored before the split reads it three times."""
    clean = stored(clean_ratings(document_ratings(spark, folder)), "ratings")
    return split_two_way(clean, "review_id", "label")


def _choose(column: Column, choices: dict) -> Column:
    chosen = F.lit(None)
    for key, value in choices.items():
        chosen = F.when(column == key, F.lit(value)).otherwise(chosen)
    return chosen


def order_reviews(spark: SparkSession, folder: str, dealt: bool = True) -> DataFrame:
    """``(review_id, text, Rating)``: a review rendered from each order's status, priority, price and date.

    Not ``dealt``: rendered where the orders are read, for steps that begin by combining equal texts.
    """
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    orders = read(spark, folder, "orders").select(*columns)
    return rendered_orders(spread(orders, "o_orderkey", ORDER_BYTES) if dealt else orders)


def rendered_orders(orders: DataFrame) -> DataFrame:
    season = F.array(*[F.lit(s) for s in SEASON_SENTENCES])
    paid = F.floor("o_totalprice").cast("string")
    text = F.concat_ws(
        " ", _choose(F.col("o_orderstatus"), STATUS_SENTENCES), _choose(F.col("o_orderpriority"), PRIORITY_SENTENCES),
        F.concat(F.when(F.col("o_totalprice") > 100000, F.lit(DEAR_SENTENCE)).otherwise(F.lit(CHEAP_SENTENCE)), paid, F.lit(".")),
        F.element_at(season, F.quarter("o_orderdate")))
    stars = (3.0 + _choose(F.col("o_orderstatus"), STATUS_STARS) + _choose(F.col("o_orderpriority"), PRIORITY_STARS)).cast("string")
    rating = F.when(F.col("o_custkey") % 97 == 0, "Like").when(F.col("o_custkey") % 89 != 0, stars)
    return orders.select(F.col("o_orderkey").alias("review_id"), text.alias("text"), rating.alias("Rating"))


def order_ratings(spark: SparkSession, folder: str, dealt: bool = True) -> DataFrame:
    return order_reviews(spark, folder, dealt).select("review_id", F.col("text").alias("Review"), "Rating")


def order_gold(spark: SparkSession, folder: str, dealt: bool = True) -> DataFrame:
    """``(review, aspect, true_label)``: one aspect of each order's review, labelled by its stars; some aspects do not occur."""
    aspect = F.element_at(F.array(*[F.lit(a) for a in DEFAULT_ASPECTS]), (F.col("review_id") % len(DEFAULT_ASPECTS) + 1).cast("int"))
    stars = F.col("Rating").try_cast("double")
    label = F.when(stars < 2.5, "Negative").when(stars > 3.5, "Positive").otherwise("Neutral")
    return order_reviews(spark, folder, dealt).select(F.col("text").alias("review"), aspect.alias("aspect"), label.alias("true_label"))


def single_word_counts(reviews: DataFrame) -> DataFrame:
    """``(term, n_reviews)`` of the content words."""
    return tm.vocabulary(tm.term_mentions(tm.prepare(reviews, mode=tm.NOUNS)))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    """``(term, n_reviews)`` of the documents' content words, stored once for all that is derived from them."""
    return stored(single_word_counts(document_reviews(spark, folder)), "words")


def corpus_lexicon(spark: SparkSession, folder: str, words: DataFrame | None = None) -> DataFrame:
    """``(term, aspect, ord)``: the most widespread longer words of the documents, dealt out to the default aspects.

    A top-k: ``LEXICON_SIZE`` rows whatever the size of the corpus. Stored, because several steps use it.
    """
    words = single_word_counts(document_reviews(spark, folder)) if words is None else words
    counts = words.filter(F.length("term") >= LEXICON_MIN_LENGTH)
    order = [F.col("n_reviews").desc(), F.col("term")]
    ranked = counts.orderBy(*order).limit(LEXICON_SIZE).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    ord_ = ((F.col("_rank") - 1) % len(DEFAULT_ASPECTS)).cast("int")
    aspect = F.element_at(F.array(*[F.lit(a) for a in DEFAULT_ASPECTS]), ord_ + 1)
    return stored(ranked.select("term", aspect.alias("aspect"), ord_.alias("ord")), "lexicon")


def benchmark_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """``(term, aspect, ord)``: the first ``PHRASE_WORDS`` words of each stretch between punctuation marks of the benchmark, dealt out by length."""
    items = read(spark, folder, "benchmark").select(F.explode(F.split(F.array_join(F.transform(
        tx.plain_words(tx.term_tokens(tx.light_clean(F.col("text")))), lambda t: F.coalesce(t, F.lit("|"))), " "), r"\|")).alias("run"))
    term = F.array_join(F.slice(F.split(F.trim("run"), " "), 1, PHRASE_WORDS), " ")
    terms = items.select(term.alias("term")).filter(F.col("term") != "").distinct()
    ord_ = (F.length("term") % len(DEFAULT_ASPECTS)).cast("int")
    return stored(terms.select("term", F.element_at(F.array(*[F.lit(a) for a in DEFAULT_ASPECTS]), ord_ + 1).alias("aspect"), ord_.alias("ord")), "phrases")


def aspect_words(lexicon: DataFrame) -> DataFrame:
    """``(aspect, ord)`` with a word of the corpus for each aspect name: the first of its terms."""
    return lexicon.groupBy("ord").agg(F.min("term").alias("aspect")).select("aspect", "ord")


def token_vectors(spark: SparkSession, folder: str, tokens: DataFrame) -> DataFrame:
    """``(token, vec)``: every distinct token mapped by hash to one row of the embeddings table."""
    embeddings = read(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = embeddings.agg(F.count(F.lit(1))).scalar()
    spot = F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("bigint") % n
    hashed = tokens.select("token").withColumn("vec_id", spot)
    return stored(hashed.join(embeddings, "vec_id").select("token", "vec"), "vectors")


def document_vectors(spark: SparkSession, folder: str, words: DataFrame) -> DataFrame:
    return token_vectors(spark, folder, words.select(F.col("term").alias("token")))


def document_lemmas(words: DataFrame) -> DataFrame:
    return stored(tm.plural_lemmas(words.select(F.col("term").alias("token"))), "lemmas")


def benchmark_words(spark: SparkSession, folder: str) -> DataFrame:
    """``(token)``: the words of the benchmark table, used as a noun list."""
    items = read(spark, folder, "benchmark").select(F.col("item_id").alias("review_id"), "text")
    return single_word_counts(items).select(F.col("term").alias("token"))


def plain_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, id, text)`` of all three text tables."""
    documents = read(spark, folder, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("id"), "text")
    pages = read(spark, folder, "pages").select(F.lit("pages").alias("src"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    turns = read(spark, folder, "conversations").select(
        F.lit("conversations").alias("src"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return spread(documents, "id").unionByName(spread(pages, "id")).unionByName(spread(turns, "id"))
