"""The registered queries: every operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plateview.functions.rows import settled
from plateview.llm import decontaminate, langid, line_runs, maintext, minhash, mixing, parity, prefix_trie, secrets, spotsigs, substrings, tokenspans, warczip


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text", "source")
    mix, sizes, targets = mixing.mix_by_weight(documents, F.array("source"))
    sources = F.broadcast(mixing.source_table(spark, sizes, targets))    # at most MAX_PATTERNS rows
    mix = mix.withColumn("source", F.col("pattern")[0])
    return (mix.join(sources, mix["source"].eqNullSafe(sources["source"]))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op2_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    beside = spotsigs.with_next(documents)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    keep = ["doc_id", "n_chars", "sigs", "next_sigs", "edited"]
    step = settled(beside, ["doc_id", "sigs", "next_sigs"], F.struct(F.length("text").cast("long").alias("n_chars"), edited.alias("edited")))
    found = spotsigs.signatures(step, keep, F.col("edited"), "edited_sigs")
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.printed(F.col("sigs")).alias("fingerprint"),
                        spotsigs.printed(F.col("edited_sigs")).alias("edited_fingerprint"),
                        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.fit(documents.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(documents, model, ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text")
    return minhash.near_duplicates(documents).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages", "page_id", "url", "html")
    found = maintext.extract(pages, maintext.fit(pages), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text")
    benchmark = _table(spark, folder, "benchmark", "item_id", "text")
    return decontaminate.matches(documents, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op7_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    records = warczip.round_trip(_table(spark, folder, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text")
    return line_runs.without_repeats(documents).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.without_repeats(_table(spark, folder, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents", "doc_id", "text")
    found = secrets.scan(documents, secrets.fit(documents), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.turn_digests(_table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie.prefix_trie(*prefix_trie.with_borrowed_heads(turns))


def op12_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity.similar_sets(_table(spark, folder, "documents", "doc_id", "text"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return tokenspans.aligned(_table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_spot_signatures, op3_language_id, op4_minhash_dedup, op5_main_text, op6_decontamination,
    op7_warc_packages, op8_line_dedup, op9_substring_dedup, op10_secret_scan, op11_prefix_trie, op12_parity_join, op13_token_alignment)}
