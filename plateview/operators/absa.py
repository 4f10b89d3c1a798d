"""Aspect-based sentiment for whole tables of reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plateview.functions import text as tx
from plateview.functions.rows import settled
from plateview.operators.aspects import each_aspect, extract_aspects
from plateview.operators.joins import lookup_join
from plateview.operators.metrics import confusion, headline, report
from plateview.operators.ratings import text_id
from plateview.schemas import NO_ASPECTS_MESSAGE, NOT_DETECTED
from plateview.sources.scratch import stored

SENTENCE, FULL_REVIEW = "sentence", "full_review"
KEYS = ["review_id", "ord", "aspect"]


def _evidence(detected: DataFrame, word_boundary: bool) -> DataFrame:
    """A row per review and aspect with its evidence: the sentences that mention it, or all of them if none does."""
    mentioning = tx.sentences_mentioning(F.col("sentences"), F.col("forms"), word_boundary)
    return (each_aspect(detected, "review_id", "cleaned", "sentences")
            .withColumn("_matched", mentioning)
            .withColumn("evidence", F.when(F.size("_matched") > 0, F.col("_matched")).otherwise(F.col("sentences")))
            .drop("_matched"))


def contexts(detected: DataFrame, context_mode: str = SENTENCE, word_boundary: bool = False) -> DataFrame:
    """``(review_id, ord, aspect, forms, evidence, context)``."""
    if context_mode == FULL_REVIEW:
        return (each_aspect(detected, "review_id", "cleaned", "sentences")
                .select(*KEYS, "forms", F.col("sentences").alias("evidence"), F.col("cleaned").alias("context")))
    if context_mode != SENTENCE:
        raise ValueError(f"unknown context mode {context_mode!r}")
    return _evidence(detected, word_boundary).select(*KEYS, "forms", "evidence", F.array_join("evidence", " ").alias("context"))


def score_contexts(table: DataFrame, scorer, with_evidence: bool = True) -> DataFrame:
    """``(review_id, ord, aspect, label, confidence, n_evidence[, evidence])``."""
    counted = table.withColumn("n_evidence", F.size("evidence"))
    carry = ["n_evidence", "evidence"] if with_evidence else ["n_evidence"]
    return scorer.score(counted, KEYS, carry).select(*KEYS, "label", "confidence", *carry)


def score_detected(detected: DataFrame, scorer, context_modes: list[str], with_evidence: bool = True, word_boundary: bool = False) -> DataFrame:
    """``(review_id, ord, aspect, mode, class_id, label, confidence, n_evidence[, evidence])`` by a scorer that answers several asks about a text.

    A review is tokenised and its terms are looked up once; aspects and context modes only name the sentences they are about.
    """
    if not set(context_modes) <= {SENTENCE, FULL_REVIEW}:
        raise ValueError(f"unknown context mode in {context_modes!r}")
    reviews = settled(detected.select("review_id", "sentences", "detected"), ["review_id", "sentences", "detected"], F.struct(
        F.transform("sentences", F.lower).alias("_low"), F.transform("sentences", lambda s: tx.words(s)).alias("_lists")))

    def marked(d):
        return F.struct(d["ord"].alias("ord"), d["aspect"].alias("aspect"), d["forms"].alias("forms"),
                        tx.mentions(F.col("_low"), d["forms"], word_boundary).alias("marks"))

    def asks(d):
        # Without a sentence that mentions the aspect the whole review is its context.
        some = F.when(F.exists(d["marks"], lambda m: m), d["marks"])
        chosen = {SENTENCE: some, FULL_REVIEW: F.lit(None).cast("array<boolean>")}
        return F.array(*[F.struct(d["ord"].alias("ord"), d["aspect"].alias("aspect"), d["forms"].alias("forms"), F.lit(mode).alias("mode"),
                                  chosen[mode].alias("which"), F.coalesce(F.size(F.filter(chosen[mode], lambda m: m)), F.lit(-1)).alias("n"))
                         for mode in context_modes])

    rows = settled(reviews, ["review_id", "sentences", "_lists"], F.struct(F.flatten(F.transform(F.transform("detected", marked), asks)).alias("_asks")))
    rows = rows.withColumn("_n", F.size("sentences"))
    fields, carry = ["ord", "aspect", "mode", "n"], ["_n"]
    if with_evidence:
        rows = rows.withColumn("_asks", F.transform("_asks", lambda a: F.struct(
            *[a[f].alias(f) for f in ["ord", "aspect", "forms", "mode", "which", "n"]], a["which"].alias("marks"))))
        fields, carry = [*fields, "marks"], [*carry, "sentences"]
    scored = scorer.score_asks(rows, ["review_id"], fields, carry)
    scored = scored.withColumn("n_evidence", F.when(F.col("n") < 0, F.col("_n")).otherwise(F.col("n")))
    columns = [*KEYS, "mode", "class_id", "label", "confidence", "n_evidence"]
    if not with_evidence:
        return scored.select(*columns)
    chosen = F.filter("sentences", lambda s, i: F.get("marks", i))
    return scored.select(*columns, F.when(F.col("marks").isNull(), F.col("sentences")).otherwise(chosen).alias("evidence"))


def analyze_reviews(reviews: DataFrame, lexicon: DataFrame, scorer, context_mode: str = SENTENCE,
                    with_evidence: bool = True, word_boundary: bool = False, **extraction) -> DataFrame:
    """One row per review and detected aspect: label, confidence and evidence.

    Aspects that are not mentioned are absent, never defaulted. ``extraction`` goes to ``extract_aspects``.
    """
    detected = extract_aspects(reviews, lexicon, **extraction)
    if hasattr(scorer, "score_asks"):
        return score_detected(detected, scorer, [context_mode], with_evidence, word_boundary).drop("mode", "class_id")
    return score_contexts(contexts(detected, context_mode, word_boundary), scorer, with_evidence)


def distinct_texts(reviews: DataFrame, text: str = "text") -> DataFrame:
    """``(review_id, text)``: each distinct text once, identified by itself.

    Hash and text are both keys of the grouping, which is then hashed and combined before the shuffle.
    """
    return reviews.select(text_id(F.col(text)).alias("review_id"), F.col(text).alias("text")).distinct()


def once_per_text(reviews: DataFrame, analyze: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``analyze`` of ``(review_id, text)`` where texts recur: each distinct text is analysed once, and its rows are given to all of its reviews.

    The work then grows with the distinct texts; only ids and hashes of the reviews move. The results of the texts are stored.
    """
    results = stored(analyze(distinct_texts(reviews, text)), "texts")
    keyed = reviews.select("review_id", text_id(F.col(text)).alias("_text"))
    found = lookup_join(keyed, results.withColumnRenamed("review_id", "_text"), ["_text"])
    return found.select(*results.columns)


def qualitative(results: DataFrame, reviews: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Results for reading: evidence sentences joined to one string; with ``reviews`` their text as ``review``, too."""
    shown = results.select("review_id", "aspect", F.col("label").alias("predicted_label"), "confidence",
                           F.array_join("evidence", " | ").alias("evidence"))
    if reviews is None:
        return shown
    return shown.join(reviews.select("review_id", F.col(text).alias("review")), "review_id", "left")


def format_results(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(review_id, report)``: a line per aspect, names padded to the widest; a message if there is none."""
    lines = results.groupBy("review_id").agg(
        F.max(F.length("aspect")).alias("width"),
        F.sort_array(F.collect_list(F.struct("ord", "aspect", "label", "confidence"))).alias("rows"))

    def line(r):
        shown = F.rpad(tx.capitalize(r["aspect"]), F.col("width"), F.lit(" "))
        return F.concat(shown, F.lit(" -> "), r["label"], F.lit(" ("), r["confidence"].cast("string"), F.lit(")"))

    text = lines.select("review_id", F.array_join(F.transform("rows", line), "\n").alias("report"))
    return (reviews.select("review_id").join(text, "review_id", "left")
            .withColumn("report", F.coalesce("report", F.lit(NO_ASPECTS_MESSAGE))))


def compare_results(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Two result sets side by side, by review and aspect; ``agree`` is NULL unless both have the aspect."""
    def side(results: DataFrame, name: str) -> DataFrame:
        return results.select("review_id", "aspect", F.col("label").alias(f"{name}_label"),
                              F.col("confidence").alias(f"{name}_conf"))
    both = side(left, left_name).join(side(right, right_name), ["review_id", "aspect"], "full_outer")
    # A comparison with NULL is NULL, which is what an aspect on one side only should give.
    return both.withColumn("agree", F.col(f"{left_name}_label") == F.col(f"{right_name}_label"))


def compared_once_per_text(reviews: DataFrame, analyze_left: Callable[[DataFrame], DataFrame], analyze_right: Callable[[DataFrame], DataFrame],
                           left_name: str, right_name: str, text: str = "text") -> DataFrame:
    """``compare_results`` of two analyses of ``(review_id, text)`` where texts recur: each distinct text is analysed and compared once.

    A text's comparison is one row, which all of its reviews get; rows are made of it there, so the two result sets of the reviews
    never meet. Ids that are missing or repeat are found first, and only reviews with such an id are compared as ``compare_results`` does.
    """
    texts = stored(distinct_texts(reviews, text), "distinct")
    left, right = stored(analyze_left(texts), "left"), stored(analyze_right(texts), "right")
    compared = compare_results(left, right, left_name, right_name)
    shown = [c for c in compared.columns if c != "review_id"]
    packed = stored(compared.groupBy(F.col("review_id").alias("_text")).agg(F.collect_list(F.struct(*shown)).alias("_found")), "compared")
    keyed = reviews.select("review_id", text_id(F.col(text)).alias("_text"))
    odd = stored(reviews.groupBy("review_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("review_id").isNull() | (F.col("_n") > 1))
                 .select(F.col("review_id").alias("_odd")), "odd")
    if odd.isEmpty():
        return _unpacked(keyed, packed)
    is_odd = keyed["review_id"].eqNullSafe(odd["_odd"])
    some = keyed.join(odd, is_odd, "left_semi")
    sides = [lookup_join(some, results.withColumnRenamed("review_id", "_text"), ["_text"]) for results in (left, right)]
    return _unpacked(keyed.join(odd, is_odd, "left_anti"), packed).unionByName(compare_results(*sides, left_name, right_name))


def _unpacked(keyed: DataFrame, packed: DataFrame) -> DataFrame:
    return lookup_join(keyed, packed, ["_text"]).select("review_id", F.inline("_found"))


def compare_context_modes(reviews: DataFrame, lexicon: DataFrame, scorer, word_boundary: bool = False,
                          with_review: bool = False, text: str = "text", **extraction) -> DataFrame:
    """Full-review against sentence context, per review and aspect; ``with_review`` adds the text as ``review``.

    Both contexts are asked about in one pass over one extraction. They detect the same aspects, so
    pairing them is a grouping of narrow rows, not a join of two analyses.
    """
    detected = extract_aspects(reviews, lexicon, text, **extraction)
    if hasattr(scorer, "score_asks"):
        scored = score_detected(detected, scorer, [SENTENCE, FULL_REVIEW], False, word_boundary)
    else:
        found = _evidence(detected, word_boundary)
        modes = F.explode(F.array(
            F.struct(F.lit(SENTENCE).alias("mode"), F.array_join("evidence", " ").alias("context")),
            F.struct(F.lit(FULL_REVIEW).alias("mode"), F.col("cleaned").alias("context"))))
        table = found.select(*KEYS, "forms", modes.alias("_m")).select(*KEYS, "forms", "_m.mode", "_m.context")
        scored = scorer.score(table, [*KEYS, "mode"])

    def of(mode: str, column: str):
        return F.max(F.when(F.col("mode") == mode, F.col(column)))

    paired = scored.groupBy(*KEYS).agg(
        of(FULL_REVIEW, "class_id").alias("_full"), of(FULL_REVIEW, "confidence").alias("full_review_conf"),
        of(SENTENCE, "class_id").alias("_sent"), of(SENTENCE, "confidence").alias("sentence_conf"))
    names = F.array(*[F.lit(n) for n in scorer.names])
    shown = paired.select(
        "review_id", "aspect",
        tx.capitalize(F.get(names, F.col("_full"))).alias("full_review_label"), "full_review_conf",
        tx.capitalize(F.get(names, F.col("_sent"))).alias("sentence_label"), "sentence_conf",
        (F.col("_full") == F.col("_sent")).alias("agree"))
    return shown.join(reviews.select("review_id", F.col(text).alias("review")), "review_id", "left") if with_review else shown


# --- agreement with hand-made labels ---------------------------------------------------

def gold_reviews(gold: DataFrame) -> DataFrame:
    """``(review_id, text)``: each distinct review once, identified by its text."""
    return distinct_texts(gold, "review")


def gold_counts(gold: DataFrame, results: DataFrame) -> DataFrame:
    """``(y_true, y_pred, n)`` against results for ``gold_reviews``; aspects not found count as NotDetected.

    Equal gold rows are counted before the join, so a review repeated very often is one row in it.
    """
    wanted = (gold.groupBy(text_id(F.col("review")).alias("review_id"), "aspect", "true_label")
              .agg(F.count(F.lit(1)).alias("n")))
    found = results.select("review_id", "aspect", "label")
    return (wanted.join(found, ["review_id", "aspect"], "left")
            .groupBy(F.col("true_label").alias("y_true"), F.coalesce("label", F.lit(NOT_DETECTED)).alias("y_pred"))
            .agg(F.sum("n").alias("n")))


def score_against_gold(gold: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Headline figures, report and confusion matrix over the labels that occur."""
    counts = gold_counts(gold, results)
    return {"headline": headline(counts), "report": report(counts), "confusion": confusion(counts)}
