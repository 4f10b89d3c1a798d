"""The shape of the physical plans that the design relies on."""

import re

from pyspark.sql import functions as F

from plateview.operators import absa, aspects, features, ratings, scoring, splits
from plateview.operators import terms as tm
from plateview.sources.scratch import stored


def main_plan(table):
    """The physical plan without its scalar subqueries, which run on small tables."""
    text = table._jdf.queryExecution().executedPlan().toString()
    lines, depth = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and indent > depth:
            continue
        depth = indent if re.search(r"[:+]- +Subquery", line) or line.strip(" :+-").startswith("Subquery") else None
        if depth is None:
            lines.append(line)
    return "\n".join(lines)


def stored_reviews(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.range(200).select(F.col("id").alias("review_id"), F.lit("Great food. Slow service!").alias("text"), F.lit("x").alias("unused")).write.parquet(path)
    return spark.read.parquet(path)


def test_analysis_by_lexicon_is_one_pass_without_a_shuffle(spark, tmp_path, scorer):
    results = absa.analyze_reviews(stored_reviews(spark, tmp_path), aspects.lexicon_table(spark), scorer)
    plan = main_plan(results)
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("FileScan") == 1 and "unused" not in plan


def test_tfidf_weights_need_no_shuffle(spark, tmp_path):
    table = stored_reviews(spark, tmp_path)
    fitted = stored(features.with_idf(features.vocabulary(table, "review_id", "text"), table), "vocabulary")
    plan = main_plan(features.tfidf(table, "review_id", "text", fitted))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_scorer_counts_its_texts_once(spark, tmp_path):
    texts = stored_reviews(spark, tmp_path).withColumn("label", F.lit(0))
    plan = scoring.bayes_weights(texts, "text", "label", [0])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "rangepartitioning" not in plan


def test_batch_model_reads_its_contexts_once(spark, tmp_path):
    from test_absa import keyword_model
    scorer = scoring.BatchScorer(keyword_model(), ["negative", "neutral", "positive"])
    plan = main_plan(absa.analyze_reviews(stored_reviews(spark, tmp_path), aspects.lexicon_table(spark), scorer))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "SortAggregate" not in plan


def test_distinct_gold_reviews_are_hashed(spark, tmp_path):
    gold = stored_reviews(spark, tmp_path).select(F.col("text").alias("review"))
    plan = main_plan(absa.gold_reviews(gold))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_texts_are_cleaned_once(spark, tmp_path):
    plan = main_plan(tm.vocabulary(tm.term_mentions(tm.prepare(stored_reviews(spark, tmp_path)))))
    assert plan.count("<[^>]+>") == 1


def test_groupings_combine_before_the_shuffle(spark, tmp_path):
    table = stored_reviews(spark, tmp_path)
    for grouped in [features.vocabulary(table, "review_id", "text"), ratings.keep_first(table, "text", "review_id"),
                    splits.leaked_texts(table.withColumn("split", F.lit("train")), "text", ["train", "test"])]:
        plan = main_plan(grouped)
        assert "partial_" in plan and "SortAggregate" not in plan and "CartesianProduct" not in plan


def test_split_does_not_shuffle_the_rows(spark, tmp_path):
    table = stored_reviews(spark, tmp_path).withColumn("label", (F.col("review_id") % 2).cast("int"))
    plan = main_plan(splits.split_two_way(table, "review_id", "label"))
    top = plan.splitlines()[:5]
    assert any("BroadcastHashJoin" in line for line in top) and "SortMergeJoin" not in plan
    # The text is read by the assignment only, not by the passes that look for the cut.
    assert len(re.findall(r"ReadSchema: struct<[^>]*text", plan)) == 1
