"""Text functions: Column in, Column out. Missing text stays NULL throughout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from plateview.schemas import STOP_WORDS

# What the cleaners remove. White space is spelled out because the
# regex engine's own classes leave out some of the separators that count here.
SPACES = r"[ \t\n\r\f\x0b\x1c-\x1f]"
SPACE_CHARS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f"
HTML_TAG = r"<[^>]+>"
URL = r"(?U)(https?://[^\s\x1c-\x1f]+)|(www\.[^\s\x1c-\x1f]+)"
MENTION = r"@[\p{L}\p{N}_]+"
NON_ASCII = r"[^\x00-\x7F]+"
# An address is a whole run of non-blanks with an @ in it. Anchoring at the start of
# the run keeps the match linear on long unbroken strings.
ADDRESS = r"(?U)(?<![^\s\x1c-\x1f])[^\s\x1c-\x1f]*@[^\s\x1c-\x1f]*[\s\x1c-\x1f]?"
CURLY_QUOTES = "[‘’ʼ]"
SENTENCE_GAP = r"(?<=[.!?])" + SPACES + "+"
WORD = r"[\p{L}\p{N}_]{2,}"
TERM_TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)*|[^a-z0-9 ]+"


def _blank_out(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, " ")
    return text


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES + "+", " "))


def _ascii_squeezed(text: Column) -> Column:
    """``squeeze`` of a text without its non-ASCII characters, a batch of texts at a time.

    A regex replacement writes every blank anew, which takes most of the time of a cleaning. ``str.split`` cuts ASCII at ``SPACES``.
    """
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        import re
        other = re.compile(r"[^\x00-\x7F]+")
        return pd.Series([" ".join((t if t.isascii() else other.sub(" ", t)).split()) if isinstance(t, str) else None for t in texts], dtype=object)

    return run(F.make_valid_utf8(text))


def light_clean(text: Column, normalize_quotes: bool = False) -> Column:
    """Remove tags, links, @mentions and non-ASCII; keep case and punctuation."""
    if normalize_quotes:
        text = F.regexp_replace(text, CURLY_QUOTES, "'")
    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")) | F.contains(text, F.lit("www."))
    return _ascii_squeezed(F.when(marked, _blank_out(text, HTML_TAG, URL, MENTION)).otherwise(text))


def aggressive_clean(text: Column) -> Column:
    """Lower-case letters and digits only; links and addresses removed."""
    return squeeze(_blank_out(F.lower(text), URL, ADDRESS, NON_ASCII, "[^A-Za-z0-9]"))


def letter_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case runs of ASCII letters, without the given stop words."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), 0), F.lower)
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop_words))
    return tokens


def classical_clean(text: Column, stop_words: list[str] | None = None) -> Column:
    """Bag-of-words text. Stemming is a vocabulary job: see ``operators.stems``."""
    return F.array_join(letter_tokens(text, stop_words), " ")


def split_sentences(text: Column) -> Column:
    """Sentences in order: cut at white space after ``.``, ``!`` or ``?``."""
    parts = F.transform(F.split(text, SENTENCE_GAP), lambda s: F.btrim(s, F.lit(SPACE_CHARS)))
    return F.filter(parts, lambda s: s != "")


def words(text: Column) -> Column:
    """Lower-case word tokens of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _tail(tokens: Column, start: int) -> Column:
    return F.slice(tokens, start, F.greatest(F.size(tokens) - (start - 1), F.lit(0)))


def ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams of an array column; n-grams touching a NULL are left out."""
    grams = tokens
    for start in range(2, n + 1):
        grams = F.zip_with(grams, _tail(tokens, start), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull())


def unigrams_and_bigrams(tokens: Column) -> Column:
    """Pass a column that holds the tokens, not the expression that makes them: it is referred to several times."""
    return F.concat(tokens, ngrams(tokens, 2))


def truncate_tokens(tokens: Column, max_length: int) -> Column:
    return F.slice(tokens, 1, max_length)


def content_words(cleaned: Column, stop_words: list[str] | None = None) -> Column:
    """Word sequence of cleaned text with NULL at every stop word, number or punctuation mark.

    The NULLs delimit candidate phrases. Sentence ends are punctuation, so no phrase
    crosses a sentence.
    """
    return masked_words(term_tokens(cleaned), stop_words)


def masked_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    """``content_words`` of the ``term_tokens``."""
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.transform(tokens, lambda t: F.when(t.rlike("^[a-z]+$") & ~t.isin(stop), t))


def term_tokens(cleaned: Column) -> Column:
    """Words, numbers and punctuation marks in order, in lower case and without possessive endings."""
    plain = F.regexp_replace(F.lower(cleaned), r"'s\b", " ")
    return F.regexp_extract_all(plain, F.lit(TERM_TOKEN), 0)


def plain_words(tokens: Column) -> Column:
    """``term_tokens`` with NULL at punctuation only: what lexicon phrases are matched on."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[a-z0-9]"), t))


def phrase_terms(masked: Column, max_words: int = 3) -> Column:
    """Distinct candidate terms: all n-grams inside the delimited phrases."""
    return F.array_distinct(F.flatten(F.array(*[ngrams(masked, n) for n in range(1, max_words + 1)])))


def single_terms(masked: Column) -> Column:
    """Distinct single-word candidate terms."""
    return F.array_distinct(F.filter(masked, lambda t: t.isNotNull()))


def mentions(lowered: Column, forms: Column, word_boundary: bool = False) -> Column:
    """For each sentence, given in lower case, whether it contains any of the forms."""
    if word_boundary:
        def found(sentence, form):
            return F.regexp_like(sentence, F.concat(F.lit(r"(?i)\b\Q"), form, F.lit(r"\E\b")))
    else:
        found = F.contains
    return F.transform(lowered, lambda s: F.exists(forms, lambda f: found(s, f)))


def sentences_mentioning(sentences: Column, forms: Column, word_boundary: bool = False) -> Column:
    """Sentences that contain any of the forms, ignoring case, in order. Each is put into lower case once."""
    both = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    if word_boundary:
        def found(sentence, form):
            return F.regexp_like(sentence, F.concat(F.lit(r"(?i)\b\Q"), form, F.lit(r"\E\b")))
    else:
        found = F.contains
    return F.transform(F.filter(both, lambda x: F.exists(forms, lambda f: found(x["low"], f))), lambda x: x["s"])


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


# The next two work on named columns: they refer to an array several times, and an expression
# in its place would be computed as often. Select the array under the name first.

def run_starts(ordered: str) -> Column:
    """Positions in a sorted array where a new value begins."""
    values = F.col(ordered)
    return F.when(F.size(values) > 0, F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1))))


def run_counts(ordered: str, starts: str) -> Column:
    """Array of ``(term, tf)``: each distinct value of a sorted array with the length of its run."""
    values, at = F.col(ordered), F.col(starts)
    return F.transform(at, lambda s, k: F.struct(
        F.get(values, s).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(values)) - s).alias("tf")))
