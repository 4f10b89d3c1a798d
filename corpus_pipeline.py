"""A training corpus from the documents: language, repeated lines, near-duplicates, benchmark passages, mix.

Each stage gets what its predecessor kept. All but the last return the columns of documents; the last
returns the documents that the mix takes, with the words it takes of each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plateview.llm import decontaminate, langid, line_runs, minhash, mixing
from plateview.llm.columns import set_aside
from plateview.sources.scratch import shared_folder

MIN_SCORE = 0.4     # calibrated probability below which a language is not trusted


def _columns(table: DataFrame, like: DataFrame) -> DataFrame:
    return table.select(*[F.col(f"`{c}`") for c in like.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language the model cannot tell."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    plain, back = set_aside(docs, ["lang_pred", "score"])
    found = langid.identify(plain, model)
    if model.languages:
        found = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    else:                       # nothing labelled to learn from: only texts without a letter go
        found = found.filter(F.col("text").rlike(r"\p{L}"))
    return _columns(found, plain).withColumnsRenamed(back)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated line runs; a document of which nothing is left goes."""
    plain, back = set_aside(docs, ["n_lines", "n_removed"])
    cut = line_runs.without_repeats(plain)
    kept = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _columns(kept.withColumn("n_chars", F.length("text").cast("long")), plain).withColumnsRenamed(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return _columns(minhash.deduplicated(docs), docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return _columns(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, size, target, taken)`` of the documents that the mix takes."""
    mix, sizes, targets = mixing.mix_by_weight(docs.select("doc_id", "text", "source"), F.array("source"))
    sources = F.broadcast(mixing.source_table(spark, sizes, targets))
    mix = mix.filter(F.col("taken") > 0).withColumn("_source", F.col("pattern")[0])
    return (mix.join(sources, mix["_source"].eqNullSafe(sources["source"]))
            .select("doc_id", "source", "size", "target", "taken"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("source mix", mix_sources),
]

# The language model and the seeded choice of documents have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
