import pytest
from pyspark.sql import functions as F

from plateview.operators import ratings
from plateview.sources import files
from plateview.sources.scratch import shared_folder, spread, stored

RATINGS = '''Restaurant,Review,Rating,7514
A,"great soup, ""really""
two lines",5,
A,"great soup, ""really""
two lines",4,
B,bad bread,1,
B,NA,3,
B,no stars,,
C,Like,Like,
'''


def test_ratings_file(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text(RATINGS)
    raw = files.read_ratings_csv(spark, str(path))
    assert raw.columns == ["review_id", "Review", "Rating"] and raw.count() == 6
    got = {r["Review"]: r["label"] for r in ratings.clean_ratings(raw).collect()}
    assert got == {'great soup, "really"\ntwo lines': 2, "bad bread": 0}


def test_parquet_ratings_read_only_their_columns(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    spark.createDataFrame([(1, "a", "5", "x")], "review_id long, Review string, Rating string, extra string").write.parquet(path)
    table = files.read_ratings_parquet(spark, path)
    assert table.columns == ["review_id", "Review", "Rating"]
    assert "extra" not in table._jdf.queryExecution().executedPlan().toString()


def test_gold_file_needs_its_columns(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text("review,aspect\nx,food\n")
    with pytest.raises(ValueError, match="true_label"):
        files.read_gold_csv(spark, str(path))
    path.write_text("review,aspect,true_label,by\nx,food,Positive,me\n")
    assert files.read_gold_csv(spark, str(path)).collect() == [("x", "food", "Positive")]


def test_text_lines_and_json(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("one\n\n   \ntwo\n")
    lines = files.read_review_lines(spark, str(tmp_path / "lines.txt"))
    assert sorted(r["text"] for r in lines.collect()) == ["one", "two"]
    files.write_json(lines, str(tmp_path / "out"))
    assert sorted(r["text"] for r in files.read_json(spark, str(tmp_path / "out"), lines.schema).collect()) == ["one", "two"]


def test_stored_tables_keep_rows_and_schema(spark):
    table = spark.createDataFrame([(1, [1.5]), (2, None)], "id long, v array<double>")
    again = stored(table, "t")
    assert sorted(again.collect()) == sorted(table.collect()) and again.schema.simpleString() == table.schema.simpleString()
    assert shared_folder(spark) in again.inputFiles()[0]


def test_spread_moves_only_tables_with_few_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() == cores
    assert "Exchange" not in spread(spark.range(0, 100, 1, cores), "id")._jdf.queryExecution().executedPlan().toString()


def test_scorer_as_a_saved_pipeline_stage(spark, scorer, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from plateview.sources import models

    texts = spark.createDataFrame([(1, "great tasty food", 2), (2, "awful cold food", 0), (3, "okay food", 1)], "review_id long, Review string, label int")
    contexts = spark.createDataFrame([(1, "great food here", ["food"]), (2, "cold awful service", ["service"]), (3, None, None)],
                                     "review_id long, context string, forms array<string>")
    fitted = Pipeline(stages=[models.BayesSentiment("Review", "label")]).fit(texts)
    before = sorted(map(tuple, fitted.transform(contexts).collect()))
    fitted.write().save(str(tmp_path / "pipeline"))
    assert sorted(map(tuple, PipelineModel.load(str(tmp_path / "pipeline")).transform(contexts).collect())) == before
    path = str(tmp_path / "scorer")
    for _ in range(2):      # replaces what is there
        models.save_scorer(scorer, path)
    again = models.load_scorer(path)
    assert again.classes == scorer.classes and again.names == scorer.names
    assert sorted(map(tuple, again.score(contexts, ["review_id"]).collect())) == sorted(map(tuple, scorer.score(contexts, ["review_id"]).collect()))


def test_batch_model_scores_as_the_rows_do(spark):
    """Logits of the predictor in Python equal the relational ones on whole texts."""
    from plateview.operators import gradient, scoring

    texts = spark.createDataFrame([(1, "great tasty food", 2), (2, "awful cold food", 0), (3, "okay food and food", 1), (4, "great view", 2)],
                                  "review_id long, Review string, label int")
    vocabulary = gradient.numbered(texts, "Review", "review_id", 50)
    rows = gradient.rows_of(texts, vocabulary, "Review", ["review_id", "label"], 50)
    model = gradient.fit(rows, vocabulary, [0, 1, 2], 5, 1.0, 50)
    wanted = {r.review_id: r.y_pred for r in gradient.predict(rows, model, 50).collect()}
    scorer = scoring.BatchScorer(scoring.StepPredictor(model), ["Negative", "Neutral", "Positive"])
    contexts = texts.select("review_id", F.col("Review").alias("context"), F.lit("food").alias("aspect"))
    found = {r.review_id: r.class_id for r in scorer.score(contexts, ["review_id"]).collect()}
    assert found == wanted
    nothing = scorer.score(spark.createDataFrame([(1, None, None), (2, "", "x")], "review_id long, context string, aspect string"), ["review_id"]).collect()
    assert len({r.class_id for r in nothing}) == 1


def test_a_table_that_grows_in_few_files_gets_more_partitions(spark, tmp_path):
    """The work of a task and the file that it writes stay the same size; nothing is lost."""
    path = str(tmp_path / "orders")
    spark.range(200_000).selectExpr("id", "uuid() u").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    parts = [spread(table, "id", n) for n in (1 << 30, 1 << 19, 1 << 18)]
    few, more, most = (p.rdd.getNumPartitions() for p in parts)
    assert few == spark.sparkContext.defaultParallelism < more < most <= 2 * more
    assert parts[-1].exceptAll(table).isEmpty() and parts[-1].count() == 200_000
