"""Word vectors learned from the reviews themselves."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from plateview.functions import text as tx
from plateview.functions.rows import each


def corpus_vectors(reviews: DataFrame, text: str = "text", size: int = 100, min_count: int = 5, window: int = 5,
                   epochs: int = 1, partitions: int = 1, seed: int = 42) -> DataFrame:
    """``(token, vec)`` by skip-gram over the sentences, for ``extract_aspects(..., vectors=...)``.

    Every worker and the driver hold the model: words that occur ``min_count`` times or more, times ``size`` floats. Raise
    ``min_count`` with the corpus to bound it. More ``partitions`` are trained side by side and averaged: faster, less exact.
    Blank reviews teach nothing.
    """
    cleaned = reviews.select(tx.split_sentences(tx.light_clean(F.col(text))).alias("_s"))
    sentences = each(cleaned, [], F.col("_s"), "sentence").select(tx.letter_tokens(F.col("sentence")).alias("tokens"))
    learner = Word2Vec(vectorSize=size, minCount=min_count, windowSize=window, maxIter=epochs, numPartitions=partitions, seed=seed,
                       inputCol="tokens", outputCol="_vec")
    return learner.fit(sentences).getVectors().select(F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vec"))
