"""From candidate terms to canonical aspects.

Terms are matched once per distinct term of the corpus, never once per review: an exact
lexicon hit first, the nearest aspect by word vectors for what remains. A small lexicon
alone is matched inside the row, with no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plateview.functions import vectors as vx
from plateview.functions.rows import each, settled
from plateview.operators import terms as tm
from plateview.operators.automaton import MAX_CHARS, detected_terms
from plateview.operators.boundaries import Boundaries
from plateview.operators.joins import bounded, lookup_join
from plateview.schemas import (DEFAULT_ASPECTS, DEFAULT_SYNONYMS, LEXICON, MAX_ASPECTS, MAX_INROW_LEXICON, MAX_INROW_WORDS,
                               SIMILARITY_THRESHOLD)
from plateview.sources.scratch import stored


def lexicon_table(spark: SparkSession, aspects: list[str] | None = None,
                  synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """``(term, aspect, ord)`` for the given aspects only; a term listed twice goes to the later aspect."""
    aspects = DEFAULT_ASPECTS if aspects is None else aspects
    synonyms = DEFAULT_SYNONYMS if synonyms is None else synonyms
    owner = {term: aspect for aspect, listed in synonyms.items() if aspect in aspects for term in listed}
    return spark.createDataFrame([(t, a, aspects.index(a)) for t, a in owner.items()], LEXICON)


def aspect_names(lexicon: DataFrame) -> DataFrame:
    """``(aspect, ord)`` of a lexicon."""
    return lexicon.select("aspect", "ord").distinct()


def _one_owner(lexicon: DataFrame) -> DataFrame:
    return (lexicon.groupBy("term").agg(F.max_by(F.struct("aspect", "ord"), "ord").alias("o"))
            .select("term", "o.aspect", "o.ord"))


def lexicon_size(lexicon: DataFrame) -> tuple[int, int]:
    """Characters of all terms, and the words of the longest; one small job."""
    row = lexicon.agg(F.sum(F.length("term")), F.max(F.size(F.split("term", " ")))).first()
    return int(row[0] or 0), int(row[1] or 1)


def lexicon_value(lexicon: DataFrame) -> Column:
    """The lexicon as one value that every row can use: an array of ``(ord, aspect, terms)``. For lexicons of a measured, small size."""
    grouped = (_one_owner(lexicon).groupBy("ord", "aspect")
               .agg(F.sort_array(F.collect_set("term")).alias("terms")))
    return grouped.agg(F.sort_array(F.collect_list(F.struct("ord", "aspect", "terms")))).scalar()


def detect_in_row(prepared: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(review_id, cleaned, sentences, detected)`` by lexicon only; no shuffle of the reviews."""
    terms = F.col("phrases")

    def hits(entry: Column) -> Column:
        forms = F.sort_array(F.array_intersect(terms, entry["terms"]))
        return F.struct(entry["ord"].alias("ord"), entry["aspect"].alias("aspect"), forms.alias("forms"))

    found = F.filter(F.transform(F.col("_lexicon"), hits), lambda d: F.size(d["forms"]) > 0)
    # The size test refers to the terms a second time: an expression used once would be
    # merged into the lambda and computed anew for every aspect.
    return (prepared.withColumn("_lexicon", lexicon_value(lexicon))
            .select("review_id", "cleaned", "sentences", F.when(F.size(terms) > 0, found).alias("detected")))


def detect_by_automaton(prepared: DataFrame, lexicon: DataFrame, single: bool = False) -> DataFrame:
    """``(review_id, cleaned, sentences, detected)`` by lexicon only, in one pass that reads each text once; no shuffle of the reviews.

    For lexicons of a measured size that a task can hold, of any number and length of terms; ``single``: terms of one word only.
    """
    owned = _one_owner(lexicon)
    if single:
        owned = owned.filter(~F.contains("term", F.lit(" ")))
    return prepared.select("review_id", "cleaned", "sentences", detected_terms(owned, "words").alias("detected"))


def each_aspect(detected: DataFrame, *columns: str) -> DataFrame:
    """A row per review and detected aspect: ``columns``, then ``ord, aspect, forms``.

    The test for "none" comes after the explode, where it cannot be pushed down and
    make the extraction run twice.
    """
    return detected.select(*columns, F.inline_outer("detected")).filter(F.col("aspect").isNotNull())


def phrase_vectors(terms: DataFrame, vectors: DataFrame, term: str = "term") -> DataFrame:
    """``(term, vec, norm)``: the mean word vector of each distinct phrase; unknown words count as zero.

    Phrases without a single known word, or with a zero vector, drop out.
    """
    n_words = F.size(F.split(F.col(term), " "))
    word = each(terms, [F.col(term), n_words.alias("_n")], F.split(F.col(term), " "), "token")
    known = lookup_join(word, vectors.select("token", vx.as_double(F.col("vec")).alias("vec")), ["token"])
    listed = known.groupBy(term).agg(F.first("_n").alias("_n"), F.collect_list("vec").alias("_vecs"))
    summed = F.aggregate(F.slice("_vecs", 2, F.greatest(F.size("_vecs") - 1, F.lit(0))), F.get("_vecs", F.lit(0)),
                         lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    mean = F.transform(summed, lambda x: x / F.col("_n"))
    return (each(listed, [term], F.array(mean), "vec")
            .withColumn("norm", vx.norm(F.col("vec"))).filter(F.col("norm") > 0))


def aspect_vectors_value(aspects: DataFrame, max_aspects: int = MAX_ASPECTS) -> Column:
    """``(aspect, ord, vec, norm)`` rows as one array value, in aspect order."""
    small = bounded(aspects.select("ord", "aspect", "vec", "norm"), max_aspects, "aspect vectors")
    return small.agg(F.sort_array(F.collect_list(F.struct("ord", "aspect", "vec", "norm")))).scalar()


def nearest_aspect(scored_rows: DataFrame, aspects: DataFrame, max_aspects: int = MAX_ASPECTS) -> DataFrame:
    """Adds ``ord, aspect, score``: the aspect with the highest cosine, the earlier one on a tie.

    ``scored_rows`` has ``vec`` and ``norm``. All aspects are compared inside the row, so the
    comparison produces no rows and needs no join.
    """
    vec, length = F.col("vec"), F.col("norm")
    # Rounded, so that a tie does not hang on the order of summation.
    compared = F.transform(F.col("_aspects"), lambda a: F.struct(
        F.round(vx.dot(vec, a["vec"]) / (length * a["norm"]), 9).alias("score"),
        (-a["ord"]).alias("neg"), a["aspect"].alias("aspect")))
    keep = scored_rows.columns
    best = settled(scored_rows.withColumn("_aspects", aspect_vectors_value(aspects, max_aspects)), keep, F.array_max(compared))
    return best.select(*keep, (-F.col("neg")).alias("ord"), "aspect", "score")


def score_terms(terms: DataFrame, names: DataFrame, vectors: DataFrame, max_aspects: int = MAX_ASPECTS) -> DataFrame:
    """``(term, ord, aspect, score)``: the nearest aspect of every distinct term that has a vector."""
    aspects = phrase_vectors(names.select(F.col("aspect").alias("term")), vectors).withColumnRenamed("term", "aspect")
    located = names.join(F.broadcast(bounded(aspects, max_aspects, "aspect vectors")), "aspect")
    return nearest_aspect(phrase_vectors(terms, vectors), located, max_aspects).select("term", "ord", "aspect", "score")


def match_terms(terms: DataFrame, lexicon: DataFrame, vectors: DataFrame | None = None,
                names: DataFrame | None = None, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``(term, ord, aspect, score)`` for distinct terms: synonym hits score 1, the rest by vectors."""
    owned = _one_owner(lexicon)
    exact = lookup_join(terms.select("term"), owned, ["term"]).select(
        "term", "ord", "aspect", F.lit(1.0).alias("score"))
    if vectors is None:
        return exact
    names = aspect_names(lexicon) if names is None else names
    rest = lookup_join(terms.select("term"), owned.select("term"), ["term"], "left_anti")
    return exact.unionByName(score_terms(rest, names, vectors).filter(F.col("score") >= threshold))


def term_dictionary(mentions: DataFrame, lexicon: DataFrame, vectors: DataFrame | None = None,
                    lemmas: DataFrame | None = None, nouns: DataFrame | None = None,
                    names: DataFrame | None = None, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """``(raw, term, ord, aspect)`` for every distinct raw term of the corpus that belongs to an aspect."""
    raw = mentions.select("term").distinct()
    if lemmas is None:
        forms = raw.select(F.col("term").alias("raw"), "term")
    else:
        forms = tm.lemmatize_terms(raw, lemmas).select(F.col("term").alias("raw"), F.col("lemma").alias("term"))
    if nouns is not None:
        forms = tm.keep_nouns(forms, nouns)
    matched = match_terms(forms.select("term").distinct(), lexicon, vectors, names, threshold)
    return forms.join(matched, "term").select("raw", "term", "ord", "aspect")


def group_into_aspects(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(review_id, ord, aspect, forms)``: the set of matched terms, and of their raw forms, per aspect."""
    stored_dictionary = stored(dictionary.select(F.col("raw").alias("term"), F.col("term").alias("lemma"), "ord", "aspect"),
                               "dictionary")
    hits = lookup_join(mentions, stored_dictionary, ["term"])
    both = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("term", "lemma")))))
    return hits.groupBy("review_id", "ord", "aspect").agg(both.alias("forms"))


def extract_aspects(reviews: DataFrame, lexicon: DataFrame, text: str = "text", mode: str = tm.PHRASES,
                    vectors: DataFrame | None = None, lemmas: DataFrame | None = None,
                    nouns: DataFrame | None = None, names: DataFrame | None = None,
                    threshold: float = SIMILARITY_THRESHOLD, stop_words: list[str] | None = None,
                    normalize_quotes: bool = False, max_words: int = 3, candidates: DataFrame | None = None,
                    boundaries: Boundaries | None = None) -> DataFrame:
    """``(review_id, cleaned, sentences, detected)``; ``detected`` is an array of ``(ord, aspect, forms)``.

    Where no aspect is found ``detected`` is empty, NULL or the review absent. Terms of the lexicon match at any length and with any
    words in them (in the mode of single words: single words). A lexicon alone is one pass without a shuffle: a small one of short terms
    inside the row, others up to ``automaton.MAX_CHARS`` characters by an automaton over words. A larger one, vectors, lemmas or nouns
    add a vocabulary pass, and the text then moves once, to meet its aspects. Sentences are those of ``boundaries``, if given.
    ``candidates`` are own candidate terms ``(review_id, term)`` in place of the n-grams of up to ``max_words`` content words.
    """
    size, longest = lexicon_size(lexicon)
    prepared = tm.prepare(reviews, text, mode, stop_words, normalize_quotes, max_words, longest if mode == tm.PHRASES else 1, boundaries)
    if vectors is None and lemmas is None and nouns is None and candidates is None:
        if size <= MAX_INROW_LEXICON and longest <= MAX_INROW_WORDS:
            return detect_in_row(prepared, lexicon)
        if size <= MAX_CHARS:
            return detect_by_automaton(prepared, lexicon, mode != tm.PHRASES)
        mentions = each(prepared, ["review_id"], F.col("phrases"), "term")
        dictionary = _one_owner(lexicon).select(F.col("term").alias("raw"), "term", "ord", "aspect")
    else:
        if candidates is None:
            mentions = tm.all_mentions(prepared, lexicon) if nouns is None else tm.term_mentions(prepared)
        else:
            mentions = candidates.select("review_id", "term")
            if nouns is None:
                mentions = mentions.unionByName(tm.phrase_mentions(prepared, lexicon))
        mentions = stored(mentions, "mentions")     # for the dictionary, and to meet it
        dictionary = term_dictionary(mentions, lexicon, vectors, lemmas, nouns, names, threshold)
    grouped = group_into_aspects(mentions, dictionary)
    per_review = grouped.groupBy("review_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "aspect", "forms"))).alias("detected"))
    return prepared.drop("terms", "words").join(per_review, "review_id").select("review_id", "cleaned", "sentences", "detected")


def surface_forms(detected: DataFrame) -> DataFrame:
    """``(review_id, ord, aspect, forms)`` in long form."""
    return each_aspect(detected, "review_id")


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(threshold, aspect, n_terms)``: coverage at every threshold, from one pass over the scored terms."""
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("score") >= t)
    return (each(scored, ["aspect"], passed, "threshold").groupBy("threshold", "aspect")
            .agg(F.count(F.lit(1)).alias("n_terms")))
