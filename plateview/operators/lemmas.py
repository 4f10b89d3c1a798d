"""Lemmas by suffix rules that are learned from examples, with the longest known ending deciding.

An example (token, lemma) says what to cut from the token's end and what to add. The rule is counted under every ending of the token
that holds the cut, and each ending keeps its most frequent rule; tokens that are their own lemma count, too, so an ending
that mostly stays as it is says so. All is done over a vocabulary of distinct tokens: a few rows for each, joined on the ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plateview.functions.rows import each
from plateview.operators.joins import lookup_join

LONGEST = 6         # characters of an ending; "^" before a token's first letter counts as one
MIN_SUPPORT = 2     # examples that a rule needs


def _endings(token: Column, first: Column, longest: int) -> Column:
    """Endings of ``^token`` from ``first`` characters up to ``longest``."""
    marked = F.concat(F.lit("^"), token)
    last = F.least(F.length(marked), F.lit(longest))
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda n: F.right(marked, n)))


def suffix_rules(pairs: DataFrame, longest: int = LONGEST, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``(ending, cut, add, n)`` from distinct examples ``(token, lemma)``: the most frequent rule of each ending.

    On a tie the rule that cuts less wins, then the later addition. Examples with a NULL or an empty side teach nothing.
    """
    rows = pairs.filter((F.col("token") != "") & (F.col("lemma") != "")).select("token", "lemma")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("token"), F.length("lemma"))),
                           lambda n: F.left("token", n) == F.left("lemma", n)))
    edit = rows.select("token", (F.length("token") - same).alias("cut"), F.substr(F.col("lemma"), same + 1).alias("add"))
    # The endings hold what is cut, and at least a letter.
    found = each(edit, ["cut", "add"], _endings(F.col("token"), F.greatest(F.col("cut"), F.lit(1)), longest), "ending")
    counted = found.groupBy("ending", "cut", "add").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support)
    best = counted.groupBy("ending").agg(F.max(F.struct("n", F.negative("cut").alias("_kept"), "cut", "add")).alias("b"))
    return best.select("ending", "b.cut", "b.add", "b.n")


def apply_rules(tokens: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(token, lemma)`` of distinct ``tokens(token)`` by the rule of their longest ending that has one; others are their own lemma.

    A rule that would leave nothing changes nothing. A NULL token has a NULL lemma, an empty one is its own.
    """
    ended = tokens.select("token", F.explode_outer(_endings(F.col("token"), F.lit(1), longest)).alias("ending"))
    met = lookup_join(ended, rules.select("ending", "cut", "add"), ["ending"], "left").filter(F.col("ending").isNotNull() | F.col("token").isNull())
    best = met.groupBy("token").agg(F.max(F.when(F.col("cut").isNotNull(), F.struct(F.length("ending").alias("n"), "cut", "add"))).alias("b"))
    made = F.concat(F.left("token", F.length("token") - F.col("b.cut")), F.col("b.add"))
    return best.select("token", F.when(F.col("b").isNull() | (made == ""), F.col("token")).otherwise(made).alias("lemma"))


def learned_lemmas(tokens: DataFrame, pairs: DataFrame, longest: int = LONGEST, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``(token, lemma)`` of distinct tokens: as in the examples where they have it, otherwise by the rules of the examples."""
    ruled = apply_rules(tokens, suffix_rules(pairs, longest, min_support), longest)
    known = pairs.groupBy("token").agg(F.min("lemma").alias("_known"))
    return lookup_join(ruled, known, ["token"], "left").select("token", F.coalesce("_known", "lemma").alias("lemma"))
