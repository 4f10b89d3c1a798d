"""Porter stemming (Porter 1980, with the widespread short-word and -y refinements) of a vocabulary.

Rules are Spark expressions, one projection per step, applied to distinct words only; texts
get their stems by a join with the stemmed vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plateview.functions import text as tx
from plateview.operators.joins import lookup_join
from plateview.sources.scratch import stored

# Irregular forms, and the suffix rules of each step as
# (suffix, replacement, condition). The first matching suffix decides a step.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP_1A = [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)]
STEP_2 = [
    ("ational", "ate", "m>0"), ("tional", "tion", "m>0"), ("enci", "ence", "m>0"), ("anci", "ance", "m>0"),
    ("izer", "ize", "m>0"), ("bli", "ble", "m>0"), ("alli", "al", "m>0"), ("entli", "ent", "m>0"),
    ("eli", "e", "m>0"), ("ousli", "ous", "m>0"), ("ization", "ize", "m>0"), ("ation", "ate", "m>0"),
    ("ator", "ate", "m>0"), ("alism", "al", "m>0"), ("iveness", "ive", "m>0"), ("fulness", "ful", "m>0"),
    ("ousness", "ous", "m>0"), ("aliti", "al", "m>0"), ("iviti", "ive", "m>0"), ("biliti", "ble", "m>0"),
    ("fulli", "ful", "m>0"), ("logi", "log", "m+l>0"),
]
STEP_3 = [
    ("icate", "ic", "m>0"), ("ative", "", "m>0"), ("alize", "al", "m>0"), ("iciti", "ic", "m>0"),
    ("ical", "ic", "m>0"), ("ful", "", "m>0"), ("ness", "", "m>0"),
]
STEP_4 = [
    ("al", "", "m>1"), ("ance", "", "m>1"), ("ence", "", "m>1"), ("er", "", "m>1"), ("ic", "", "m>1"),
    ("able", "", "m>1"), ("ible", "", "m>1"), ("ant", "", "m>1"), ("ement", "", "m>1"), ("ment", "", "m>1"),
    ("ent", "", "m>1"), ("ion", "", "m>1 after s or t"), ("ou", "", "m>1"), ("ism", "", "m>1"),
    ("ate", "", "m>1"), ("iti", "", "m>1"), ("ous", "", "m>1"), ("ive", "", "m>1"), ("ize", "", "m>1"),
]

def _word() -> Column:
    return F.col("_w")


def _shape() -> Column:
    return F.col("_shape")


def shape(word: Column) -> Column:
    """The word with c for each consonant and v for each vowel; y is a vowel after a consonant."""
    return F.aggregate(
        F.filter(F.split(word, ""), lambda ch: ch != ""), F.lit(""),
        lambda acc, ch: F.concat(acc, F.when(ch.isin("a", "e", "i", "o", "u"), "v")
                                 .when((ch == "y") & F.endswith(acc, F.lit("c")), "v").otherwise("c")))


def _left(column: Column, drop: int) -> Column:
    return F.substr(column, F.lit(1), F.length(column) - drop)


def _holds(condition: str | None, drop: int) -> Column:
    """A condition on the stem left after dropping ``drop`` letters."""
    stem_shape = _left(_shape(), drop)
    if condition is None:
        return F.lit(True)
    if condition == "m>0":
        return F.contains(stem_shape, F.lit("vc"))
    if condition == "m+l>0":
        return F.contains(_left(_shape(), drop - 1), F.lit("vc"))
    many = stem_shape.rlike("vc+v+c")
    if condition == "m>1 after s or t":
        return many & _left(_word(), drop).rlike("[st]$")
    return many


def _by_rules(rules: list[tuple]) -> Column:
    result = _word()
    for suffix, replacement, condition in reversed(rules):
        changed = F.concat(_left(_word(), len(suffix)), F.lit(replacement))
        result = F.when(F.endswith(_word(), F.lit(suffix)),
                        F.when(_holds(condition, len(suffix)), changed).otherwise(_word())).otherwise(result)
    return result


def _closed(column_shape: Column, word: Column) -> Column:
    """Ends consonant, vowel, consonant (not w, x, y); also a two-letter vowel-consonant word."""
    return (column_shape.rlike("cvc$") & ~word.rlike("[wxy]$")) | (column_shape == "vc")


def _step_1a() -> Column:
    return F.when(F.endswith(_word(), F.lit("ies")) & (F.length(_word()) == 4), F.concat(_left(_word(), 3), F.lit("ie"))).otherwise(_by_rules(STEP_1A))


def _tidy_after_ed(word: Column, word_shape: Column) -> Column:
    doubled = word.rlike("(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|zz)$")
    once = word_shape.rlike("^c*v+c+$|^c*v+c+v+$")
    return (F.when(word.rlike("(at|bl|iz)$"), F.concat(word, F.lit("e")))
            .when(doubled, F.when(word.rlike("[lsz]$"), word).otherwise(_left(word, 1)))
            .when(once & _closed(word_shape, word), F.concat(word, F.lit("e")))
            .otherwise(word))


def _step_1b() -> Column:
    def cut(n: int) -> Column:
        has_vowel = F.contains(_left(_shape(), n), F.lit("v"))
        return F.when(has_vowel, _tidy_after_ed(_left(_word(), n), _left(_shape(), n))).otherwise(_word())
    return (F.when(F.endswith(_word(), F.lit("ied")), F.concat(_left(_word(), 3), F.when(F.length(_word()) == 4, "ie").otherwise("i")))
            .when(F.endswith(_word(), F.lit("eed")), F.when(_holds("m>0", 3), _left(_word(), 1)).otherwise(_word()))
            .when(F.endswith(_word(), F.lit("ed")), cut(2))
            .when(F.endswith(_word(), F.lit("ing")), cut(3))
            .otherwise(_word()))


def _step_1c() -> Column:
    turns = F.endswith(_word(), F.lit("y")) & (F.length(_word()) > 2) & F.endswith(_left(_shape(), 1), F.lit("c"))
    return F.when(turns, F.concat(_left(_word(), 1), F.lit("i"))).otherwise(_word())


def _step_2a() -> Column:
    # -alli becomes -al before the rules of step 2 look at the word.
    return F.when(F.endswith(_word(), F.lit("alli")) & _holds("m>0", 4), _left(_word(), 2)).otherwise(_word())


def _step_5a() -> Column:
    stem, stem_shape = _left(_word(), 1), _left(_shape(), 1)
    once = F.contains(stem_shape, F.lit("vc")) & ~_closed(stem_shape, stem)
    return F.when(F.endswith(_word(), F.lit("e")) & (_holds("m>1", 1) | once), stem).otherwise(_word())


def _step_5b() -> Column:
    return F.when(F.endswith(_word(), F.lit("ll")) & _holds("m>1", 1), _left(_word(), 1)).otherwise(_word())


STEPS = [_step_1a, _step_1b, _step_1c, _step_2a, lambda: _by_rules(STEP_2), lambda: _by_rules(STEP_3),
         lambda: _by_rules(STEP_4), _step_5a, _step_5b]


def stem_words(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Adds ``stem`` to a table of distinct lower-case words."""
    table = vocabulary.withColumn("_w", F.col(word))
    for step in STEPS:
        table = table.withColumn("_shape", shape(_word())).withColumn("_w", step())
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    stem = F.coalesce(F.try_element_at(irregular, F.col(word)), F.when(F.length(word) <= 2, F.col(word)), _word())
    return table.withColumn("stem", stem).drop("_w", "_shape")


def stemmed_clean(texts: DataFrame, id_col: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """``(id, cleaned)``: classical cleaning with stems. Distinct words are stemmed once."""
    tokens = texts.select(id_col, F.posexplode_outer(tx.letter_tokens(F.col(text), stop_words)).alias("pos", "word"))
    stems = stored(stem_words(tokens.select("word").filter(F.col("word").isNotNull()).distinct()), "stems")
    joined = lookup_join(tokens, stems, ["word"], "left")
    placed = F.sort_array(F.collect_list(F.when(F.col("stem").isNotNull(), F.struct("pos", "stem"))))
    return joined.groupBy(id_col).agg(F.array_join(F.transform(placed, lambda x: x["stem"]), " ").alias("cleaned"))
