"""Candidate terms of a review and the vocabulary tables behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plateview.functions import text as tx
from plateview.functions.rows import each, each_placed
from plateview.operators.boundaries import Boundaries, with_sentences
from plateview.operators.joins import lookup_join

PHRASES, NOUNS = "phrases", "nouns"


def prepare(reviews: DataFrame, text: str = "text", mode: str = PHRASES, stop_words: list[str] | None = None,
            normalize_quotes: bool = False, max_words: int = 3, longest: int = 1, boundaries: Boundaries | None = None) -> DataFrame:
    """``(review_id, cleaned, sentences, terms, phrases, words)``, all inside the row.

    ``terms`` are candidates of up to ``max_words`` content words. ``phrases`` are all runs of up to ``longest`` words, stop words
    and numbers included, for a lexicon to be looked up in, ``words`` all words in order with NULL at punctuation; what a caller does not read
    is not computed. Sentences end at every mark, or as learned ``boundaries`` tell. Blank reviews keep empty arrays and drop out where these are exploded. A filter here would
    be pushed below the cleaning and compute it a second time.
    """
    if mode not in (PHRASES, NOUNS):
        raise ValueError(f"unknown candidate mode {mode!r}")
    masked = F.col("_masked")
    terms = tx.phrase_terms(masked, max_words) if mode == PHRASES else tx.single_terms(masked)
    phrases = tx.phrase_terms(F.col("_plain"), longest) if longest > 1 else tx.single_terms(F.col("_plain"))
    cleaned = reviews.select("review_id", tx.light_clean(F.col(text), normalize_quotes).alias("cleaned"))
    if boundaries is None:
        cleaned = cleaned.select("review_id", "cleaned", tx.split_sentences(F.col("cleaned")).alias("sentences"))
    else:
        cleaned = with_sentences(cleaned, boundaries, ["review_id", "cleaned"])
    return (cleaned
            .select("review_id", "cleaned", "sentences", tx.term_tokens(F.col("cleaned")).alias("_tokens"))
            .select("review_id", "cleaned", "sentences", tx.masked_words(F.col("_tokens"), stop_words).alias("_masked"),
                    tx.plain_words(F.col("_tokens")).alias("_plain"))
            .select("review_id", "cleaned", "sentences", terms.alias("terms"), phrases.alias("phrases"), F.col("_plain").alias("words")))


def term_mentions(prepared: DataFrame) -> DataFrame:
    """``(review_id, term)``, each pair once."""
    return each(prepared, ["review_id"], F.col("terms"), "term")


def phrase_mentions(prepared: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(review_id, term)`` for the phrases that the lexicon lists, whatever words they consist of."""
    return lookup_join(each(prepared, ["review_id"], F.col("phrases"), "term"), lexicon.select("term").distinct(), ["term"], "left_semi")


def all_mentions(prepared: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(review_id, term)`` of the candidate terms and of the phrases that the lexicon lists, whatever words these consist of; some pairs twice.

    Both come from one pass over the texts.
    """
    both = F.concat(F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(True).alias("own"))),
                    F.transform("phrases", lambda t: F.struct(t.alias("term"), F.lit(False).alias("own"))))
    said = each(prepared, ["review_id"], both, "t").select("review_id", "t.term", "t.own")
    listed = lookup_join(said, lexicon.select("term").distinct().withColumn("_listed", F.lit(True)), ["term"], "left")
    return listed.filter(F.col("own") | F.col("_listed")).select("review_id", "term")


def vocabulary(mentions: DataFrame) -> DataFrame:
    """``(term, n_reviews)`` over the whole corpus."""
    return mentions.groupBy("term").agg(F.count(F.lit(1)).alias("n_reviews"))


def word_degrees(reviews: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``(review_id, phrase, place, word, score)``: every word of the phrases between stop words, numbers and punctuation, of any length.

    ``score`` is the word's degree in its review, the words of all phrases that it stands in, itself included, over the number of its
    occurrences (Rose et al., 2010). One shuffle by review; a review's words are sorted there, not held.
    """
    prepared = reviews.select("review_id", tx.light_clean(F.col(text)).alias("_c")).select("review_id", tx.content_words(F.col("_c"), stop_words).alias("_m"))
    placed = (prepared.select("review_id", F.posexplode_outer("_m").alias("place", "word")).filter(F.col("place").isNotNull() & F.col("word").isNotNull())
              .repartition("review_id"))
    own = Window.partitionBy("review_id")
    runs = placed.withColumn("phrase", F.col("place") - F.row_number().over(own.orderBy("place")))
    sized = runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("review_id", "phrase")))
    word = Window.partitionBy("review_id", "word")
    return (sized.withColumn("score", F.sum("_n").over(word) / F.count(F.lit(1)).over(word))
            .select("review_id", "phrase", "place", "word", "score"))


def key_phrases(reviews: DataFrame, text: str = "text", top: int = 10, stop_words: list[str] | None = None) -> DataFrame:
    """``(review_id, rank, phrase, score, n)``: the ``top`` phrases of each review by the sum of their words' scores, and how often they occur.

    Equal scores are in the order of the phrases. Reviews without a content word have no row; rows that repeat a review_id are one review.
    """
    words = word_degrees(reviews, text, stop_words)
    said = words.groupBy("review_id", F.col("phrase").alias("_run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.round(F.sum("score"), 6).alias("score"))
    scored = said.groupBy("review_id", "phrase").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("review_id").orderBy(F.col("score").desc(), "phrase"))
    return scored.withColumn("rank", order).filter(F.col("rank") <= top).select("review_id", "rank", "phrase", "score", "n")


def plural_lemmas(tokens: DataFrame) -> DataFrame:
    """``(token, lemma)`` for plurals whose singular is itself in the vocabulary ``(token)``.

    Endings tried: -ies to -y, -es, -s; the longest attested one wins.
    """
    token = F.col("token")
    cut = F.array(
        F.when(token.rlike("..ies$"), F.struct(F.lit(3).alias("cut"), F.regexp_replace(token, "ies$", "y").alias("lemma"))),
        F.when(token.rlike("(s|x|z|ch|sh|o)es$"), F.struct(F.lit(2).alias("cut"), F.regexp_replace(token, "es$", "").alias("lemma"))),
        F.when(token.rlike("[^su]s$"), F.struct(F.lit(1).alias("cut"), F.regexp_replace(token, "s$", "").alias("lemma"))),
    )
    tried = (each(tokens, ["token"], cut, "c")
             .select("token", "c.cut", "c.lemma").filter(F.length("lemma") >= 3))
    attested = tried.join(tokens.select(F.col("token").alias("lemma")), "lemma", "left_semi")
    return attested.groupBy("token").agg(F.max(F.struct("cut", "lemma")).alias("best")).select("token", "best.lemma")


def lemmatize_terms(terms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``(term, lemma)``: every word of each distinct term replaced by its lemma, if it has one."""
    word = each_placed(terms, ["term"], F.split("term", " "), "pos", "token")
    found = lookup_join(word, lemmas, ["token"], "left")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("w")))),
                                      lambda x: x["w"]), " ")
    return found.groupBy("term").agg(joined.alias("lemma"))


def keep_nouns(terms: DataFrame, nouns: DataFrame, term: str = "term") -> DataFrame:
    """Terms whose head, the last word, is in the noun table ``(token)``."""
    headed = terms.withColumn("token", F.element_at(F.split(F.col(term), " "), -1))
    return lookup_join(headed, nouns.select("token").distinct(), ["token"]).drop("token")
