"""Sentence boundaries learned from the texts themselves, without labels.

A period after an abbreviation ends no sentence. Abbreviations are the word types that stand with a period far more often than
chance, by the log-likelihood ratio of two vocabulary counts, weighed for being short, for inner periods, and against
occurrences without a period (Kiss and Strunk, Computational Linguistics 32, 2006). After an abbreviation a
sentence ends only before a frequent sentence starter: a type that stands after certain boundaries far more often than elsewhere.
Both are vocabulary jobs: one pass counts the tokens with map-side sums, rules meet distinct tokens, and the small results are looked up inside the row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from plateview.functions import text as tx
from plateview.functions.rows import each, settled
from plateview.operators.joins import bounded, lookup_value, looked_up
from plateview.sources.scratch import stored

# Fixed values of the method.
ALWAYS = 0.99               # share of a true abbreviation's occurrences that have a period
MIN_SCORE = 0.3             # score from which a type is an abbreviation
MIN_STARTER = 30.0          # log-likelihood ratio from which a type starts sentences
MAX_ABBREVIATIONS = 50_000  # abbreviations that every row can look up; more fail the job
STARTERS = 1_000            # the most significant starters that are kept
SLOTS = 256

# A token without what surrounds it: in lower case, opening marks and what closes it cut, its periods kept.
_AROUND = r"^[^a-z0-9]+|[^a-z0-9.]+$"
_TYPE = r"^[a-z]+(?:[.-][a-z]+)*$"
_MARK = r"([.!?])[\"')\]}]*$"
_CLOSING = list(".!?\"')]}")
_CAPITAL, _SMALL = "^[^A-Za-z0-9]*[A-Z]", "^[^A-Za-z0-9]*[a-z]"
_CUT = "\ue000"             # cleaned text has no such character
_EDGE = 1e-9


class Boundaries(NamedTuple):
    """Stored tables ``(type)`` of abbreviations and of sentence starters."""

    abbreviations: DataFrame
    starters: DataFrame


def _bare_of(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), _AROUND, "")


def _type_of(bare: Column) -> Column:
    plain = F.rtrim(bare, F.lit("."))
    return F.when(F.regexp_like(plain, F.lit(_TYPE)), plain).otherwise("")


def token_facts(tokens: Column) -> Column:
    """For each token ``(type, mark, period)``: the word type (empty if it is none), its closing mark, whether its core ends in one period."""
    def facts(t: Column) -> Column:
        return F.struct(_bare_of(t).alias("bare"), F.regexp_extract(t, _MARK, 1).alias("mark"))

    def typed(x: Column) -> Column:
        return F.struct(_type_of(x["bare"]).alias("type"), x["mark"].alias("mark"),
                        (F.endswith(x["bare"], F.lit(".")) & ~F.endswith(x["bare"], F.lit(".."))).alias("period"))
    return F.transform(F.transform(tokens, facts), typed)


def _may_end(token: Column) -> Column:
    """Whether the last character is one of those that end a closing mark: without it there is no mark."""
    return F.substring(token, -1, 1).isin(*_CLOSING)


def token_counts(reviews: DataFrame, text: str = "text") -> DataFrame:
    """``(token, before, n)``: occurrences of each token of the lightly cleaned texts; ``before`` is the token before it if that may end a sentence."""
    cleaned = reviews.select("review_id", tx.light_clean(F.col(text)).alias("cleaned"))
    rows = settled(cleaned, [], F.struct(F.split("cleaned", " ").alias("_words")))
    pairs = F.transform("_words", lambda w, i: F.struct(w.alias("token"), F.when(_may_end(F.get("_words", i - 1)), F.get("_words", i - 1)).alias("before")))
    return each(rows, [], pairs, "t").groupBy("t.token", "t.before").agg(F.count(F.lit(1)).alias("n"))


def _typed(counts: DataFrame) -> DataFrame:
    """``(token, n)`` and the facts of each distinct token of ``token_counts``."""
    whole = counts.groupBy("token").agg(F.sum("n").alias("n"))
    return settled(whole, ["token", "n"], F.get(token_facts(F.array("token")), F.lit(0)))


class Seen(NamedTuple):
    """Stored ``token_counts``, and the facts of their distinct tokens."""

    pairs: DataFrame
    tokens: DataFrame


def seen(reviews: DataFrame, text: str = "text") -> Seen:
    """The one pass over the texts that all counts of ``fit`` come from."""
    pairs = stored(token_counts(reviews, text), "pairs")
    return Seen(pairs, stored(_typed(pairs), "tokens"))


def period_counts(reviews: DataFrame, text: str = "text", counted: Seen | None = None) -> DataFrame:
    """``(type, n_period, n_plain)``: occurrences of each word type with and without a final period."""
    rows = _typed(token_counts(reviews, text)) if counted is None else counted.tokens
    return (rows.filter(F.col("type") != "").groupBy("type")
            .agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("n_period"), F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("n_plain")))


def _log_likelihood(hits: Column, misses: Column, share: Column) -> Column:
    """Log-likelihood of a binomial; 0 * log 0 is 0."""
    share = F.least(F.greatest(share, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return hits * F.log(share) + misses * F.log(1 - share)


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``(type, n_period, n_plain, ratio, score)`` of the types that occur with a period.

    ``ratio`` is twice the log of how much better the counts fit a type that nearly always has a period than one that has it
    as often as any word; ``score`` multiplies it by e^-letters, by 1 + inner periods and by letters^-n_plain.
    """
    whole = counts.agg(F.sum("n_period").alias("p"), F.sum(F.col("n_period") + F.col("n_plain")).alias("n"))
    share = whole.select((F.col("p") / F.col("n")).alias("share")).scalar()
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters
    hits, misses = F.col("n_period").cast("double"), F.col("n_plain").cast("double")
    rated = counts.filter(F.col("n_period") > 0).withColumn("_share", share).withColumn(
        "ratio", 2 * (_log_likelihood(hits, misses, F.lit(ALWAYS)) - _log_likelihood(hits, misses, F.col("_share"))))
    weight = F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -misses)
    return rated.select("type", "n_period", "n_plain", "ratio", (F.col("ratio") * weight).alias("score"))


def abbreviations(reviews: DataFrame, text: str = "text", min_score: float = MIN_SCORE, counted: Seen | None = None) -> DataFrame:
    """``(type)`` of the abbreviations of a corpus."""
    return abbreviation_scores(stored(period_counts(reviews, text, counted), "periods")).filter(F.col("score") >= min_score).select("type")


def _listed(table: DataFrame, most: int, what: str) -> Column:
    return lookup_value(bounded(table.select("type"), most, what), "type", F.lit(True), SLOTS)


def _certain_ends(tokens: DataFrame, known: DataFrame, max_abbreviations: int) -> DataFrame:
    """``(before)``: the tokens that certainly end a sentence: a mark that follows neither abbreviation, initial, number nor ellipsis."""
    word = (F.col("type") != "") & (F.length("type") > 1) & F.col("period")
    loud = tokens.filter(F.col("mark").isin("!", "?"))
    calm = tokens.filter((F.col("mark") == ".") & word).join(bounded(known.select("type"), max_abbreviations, "abbreviations"), "type", "left_anti")
    return loud.select(F.col("token").alias("before")).unionByName(calm.select(F.col("token").alias("before")))


def starter_counts(reviews: DataFrame, known: DataFrame, text: str = "text", max_abbreviations: int = MAX_ABBREVIATIONS, counted: Seen | None = None) -> DataFrame:
    """``(type, n_after, n)``: how often a type follows a certain end, and how often it occurs."""
    pairs, tokens = seen(reviews, text) if counted is None else counted
    after = (pairs.filter(F.col("before").isNotNull()).join(_certain_ends(tokens, known, max_abbreviations), "before", "left_semi")
             .groupBy("token").agg(F.sum("n").alias("n_after")))
    return (tokens.filter(F.col("type") != "").select("token", "type", "n").join(after, "token", "left").groupBy("type")
            .agg(F.sum(F.coalesce("n_after", F.lit(0))).alias("n_after"), F.sum("n").alias("n")))


def starter_ratios(counts: DataFrame) -> DataFrame:
    """``(type, n_after, n, ratio)`` of types that follow certain ends more often than they occur elsewhere."""
    total = counts.agg(F.sum("n_after").cast("double").alias("b"), F.sum("n").cast("double").alias("n")).select(F.struct("b", "n").alias("t")).scalar()
    rows = counts.filter(F.col("n_after") > 0).withColumn("_t", total)
    after, rest, ends, others = F.col("n_after").cast("double"), (F.col("n") - F.col("n_after")).cast("double"), F.col("_t.b"), F.col("_t.n") - F.col("_t.b")
    same = F.col("n") / F.col("_t.n")
    here, there = after / ends, rest / F.greatest(others, F.lit(1.0))
    apart = _log_likelihood(after, ends - after, here) + _log_likelihood(rest, others - rest, there)
    alike = _log_likelihood(after, ends - after, same) + _log_likelihood(rest, others - rest, same)
    return rows.filter(here > same).select("type", "n_after", "n", (2 * (apart - alike)).alias("ratio"))


def fit(reviews: DataFrame, text: str = "text", min_score: float = MIN_SCORE, min_starter: float = MIN_STARTER, starters: int = STARTERS,
        max_abbreviations: int = MAX_ABBREVIATIONS) -> Boundaries:
    """Learn abbreviations and the ``starters`` most significant sentence starters. Missing and blank texts teach nothing."""
    counted = seen(reviews, text)
    short = stored(abbreviations(reviews, text, min_score, counted), "abbreviations")
    rated = starter_ratios(stored(starter_counts(reviews, short, text, max_abbreviations, counted), "starters")).filter(F.col("ratio") >= min_starter)
    first = rated.join(short, "type", "left_anti").orderBy(F.round("ratio", 6).desc(), "type").limit(starters).select("type")
    return Boundaries(short, stored(first, "starters"))


def with_sentences(cleaned: DataFrame, model: Boundaries, keep: list[str], max_abbreviations: int = MAX_ABBREVIATIONS, max_starters: int = STARTERS) -> DataFrame:
    """``keep`` columns and ``sentences`` of the column ``cleaned``, all inside the row.

    ``!`` and ``?`` end a sentence, and a period unless it belongs to an initial, to an abbreviation that no starter with a capital follows,
    to a number or an ellipsis before a small letter. Closing quotes and brackets stay with their sentence. Where nothing
    was learned, these are the periods of ordinary words. A missing text has NULL sentences, an empty one none.
    """
    held = (cleaned.withColumn("_short", _listed(model.abbreviations, max_abbreviations, "abbreviations"))
            .withColumn("_first", _listed(model.starters, max_starters, "sentence starters")))
    rows = settled(held, [*keep, "cleaned", "_short", "_first"], F.struct(F.split("cleaned", " ").alias("_words")))

    def rule(x: Column, after: Column) -> Column:
        small = F.regexp_like(after, F.lit(_SMALL))
        opens = F.regexp_like(after, F.lit(_CAPITAL)) & looked_up(F.col("_first"), _type_of(_bare_of(after)), SLOTS).isNotNull()
        return (F.when(x["mark"].isin("!", "?"), F.lit(True)).when(x["mark"] != ".", F.lit(False))
                .when(~x["period"], ~small)
                .when(x["type"] == "", ~small)
                .when(F.length(x["type"]) == 1, F.lit(False))
                .when(looked_up(F.col("_short"), x["type"], SLOTS).isNotNull(), opens)
                .otherwise(True))

    def ends(w: Column, i: Column) -> Column:
        return F.when(_may_end(w), F.get(F.transform(token_facts(F.array(w)), lambda x: rule(x, F.get("_words", i + 1))), F.lit(0)))

    rows = settled(rows, [*keep, "_words"], F.struct(F.transform("_words", ends).alias("_ends")))
    glued = F.array_join(F.transform("_words", lambda w, i: F.concat(w, F.when(F.get("_ends", i), F.lit(_CUT)).otherwise(" "))), "")
    cut = F.filter(F.transform(F.split(glued, _CUT), lambda s: F.btrim(s)), lambda s: s != "")
    return rows.select(*keep, cut.alias("sentences"))


def learned_sentences(reviews: DataFrame, model: Boundaries, text: str = "text") -> DataFrame:
    """``(review_id, cleaned, sentences)`` of the lightly cleaned texts."""
    return with_sentences(reviews.select("review_id", tx.light_clean(F.col(text)).alias("cleaned")), model, ["review_id", "cleaned"])
