"""TF-IDF over unigrams and bigrams, as relations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from plateview.functions import text as tx
from plateview.functions.rows import each, settled
from plateview.operators.joins import looked_up, lookup_value
from plateview.schemas import MAX_FEATURES

HELD_TERMS = 500_000        # terms that a task counts before it tells them
ROWS = 1 << 16
FEATS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType())]))


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The k terms with the highest corpus frequency ``tf``; ties in term order."""
    return counts.orderBy(F.col("tf").desc(), "term").limit(k)


def _counted(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, ``_sorted`` and ``_starts``: the n-grams of a text in order, and where a new one begins."""
    return (texts.select(*keep, tx.words(F.col(text)).alias("_tokens"))
            .select(*keep, F.sort_array(tx.unigrams_and_bigrams(F.col("_tokens"))).alias("_sorted"))
            .select(*keep, "_sorted", tx.run_starts("_sorted").alias("_starts")))


def term_frequencies(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, term, tf)``: counts per text, made inside the row by sorting its n-grams, without a shuffle."""
    return (_counted(texts, [id_col], text).transform(each, [id_col], tx.run_counts("_sorted", "_starts"), "t")
            .select(id_col, "t.term", "t.tf"))


def _joined(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and the tokens of a text as one string, which holds no blank but those between them."""
    return texts.select(*keep, F.array_join(tx.words(F.col(text)), " ").alias("_said"))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, tf, df)`` of a task's texts; a term comes again after ``HELD_TERMS`` others."""
    tf, df = Counter(), Counter()

    def told() -> Iterator[pa.RecordBatch]:
        terms = list(tf)
        for low in range(0, len(terms), ROWS):
            some = terms[low: low + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array(list(map(c.__getitem__, some)), pa.int64()) for c in (tf, df))],
                                             names=["term", "tf", "df"])
        tf.clear()
        df.clear()

    for batch in batches:
        for said in batch.column(0):
            words = (said.as_py() or "").split()
            grams = [*words, *map(" ".join, zip(words, words[1:]))]
            tf.update(grams)
            df.update(set(grams))
            if len(tf) >= HELD_TERMS:
                yield from told()
    yield from told()


def vocabulary(texts: DataFrame, id_col: str, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(term, tf, df)`` of the most frequent n-grams: each task counts its texts, and one grouping adds the counts up."""
    counts = _joined(texts, [], text).mapInArrow(_partial_counts, "term string, tf long, df long").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return top_terms(counts, max_features)


def with_idf(vocab: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """Adds the smoothed ``idf`` = ln((1 + n) / (1 + df)) + 1, n the number of texts fitted on."""
    n = fitted_on.agg(F.count(F.lit(1))).scalar()
    return vocab.withColumn("idf", F.log((n + F.lit(1.0)) / (F.col("df") + F.lit(1.0))) + 1.0)


def _sparse(held: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, after, idf = held.value
        for batch in batches:
            ends, at, x = [0], [np.zeros(0, np.int32)], [np.zeros(0)]
            for said in batch.column(batch.num_columns - 1):
                words = (said.as_py() or "").split()
                spots = [i for i in map(place.get, words) if i is not None]
                spots += [after[a][b] for a, b in zip(words, words[1:]) if a in after and b in after[a]]
                own, tf = np.unique(np.array(spots, np.int32), return_counts=True)
                raw = tf * idf[own]
                at.append(own)
                x.append(raw / np.sqrt(raw @ raw) if len(raw) else raw)
                ends.append(ends[-1] + len(own))
            feats = pa.StructArray.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(x))], names=["i", "x"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), feats)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "feats"])
    return run


def sparse_rows(texts: DataFrame, keep: list[str], text: str, vocab_idf: DataFrame) -> DataFrame:
    """``keep`` columns and ``feats``: an array of ``(i, x)`` with unit length, from a vocabulary ``(i, term, idf)`` numbered from 0; empty without known terms.

    The vocabulary is a top-k and goes through the driver to every executor; bigrams are looked up by their first word.
    """
    known = vocab_idf.select("i", "term", "idf").toArrow().to_pylist()
    place, after, idf = {}, {}, np.zeros(len(known))
    for r in known:
        first, blank, second = r["term"].partition(" ")
        if blank:
            after.setdefault(first, {})[second] = r["i"]
        else:
            place[first] = r["i"]
        idf[r["i"]] = r["idf"]
    said = _joined(texts, keep, text)
    schema = T.StructType([*said.schema.fields[:-1], T.StructField("feats", FEATS)])
    return said.mapInArrow(_sparse(texts.sparkSession.sparkContext.broadcast((place, after, idf))), schema)


def tfidf(texts: DataFrame, id_col: str, text: str, vocab_idf: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(id, term, weight)`` with unit length per text. The vocabulary is a top-k of about ``max_features`` rows.

    It is looked up inside the row, where the length is taken, too, so nothing is shuffled.
    """
    slots = max(1, max_features // 4)
    table = _counted(texts, [id_col], text).withColumn("_idf", lookup_value(vocab_idf, "term", F.col("idf"), slots))
    weighed = F.filter(F.transform(tx.run_counts("_sorted", "_starts"), lambda t: F.struct(
        t["term"].alias("term"), (t["tf"] * looked_up(F.col("_idf"), t["term"], slots)).alias("raw"))), lambda t: t["raw"].isNotNull())
    table = settled(table, [id_col], F.struct(weighed.alias("_raw")))
    length = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, t: s + t["raw"] * t["raw"]))
    table = settled(table, [id_col, "_raw"], F.struct(length.alias("_length")))
    return each(table, [id_col, "_length"], F.col("_raw"), "t").select(id_col, "t.term", (F.col("t.raw") / F.col("_length")).alias("weight"))
