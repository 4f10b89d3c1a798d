"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plateview.schemas import GOLD_FILE, MISSING_MARKERS, RATINGS_FILE


def _present(cell: Column) -> Column:
    return F.when(~cell.isin(MISSING_MARKERS), cell)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    # Quoted cells may hold line breaks. Such files cannot be split, so many files, or the
    # parquet source, are the way to read a large table in parallel.
    return (spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def _required(table: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(table.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return table


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ratings file with at least ``Review`` and ``Rating``; other columns are dropped.

    Rows have no order in Spark, so "the first copy" is the one with the smallest
    ``review_id``. A file without that column gets ids that follow its rows, which a multi-line
    read keeps in one piece; give several files their own ``review_id``.
    """
    table = _required(_csv(spark, path), ["Review", "Rating"], "ratings file")
    if "review_id" in table.columns:
        numbered = table.withColumn("review_id", F.col("review_id").cast("long"))
    else:
        numbered = table.withColumn("review_id", F.monotonically_increasing_id())
    return numbered.select("review_id", _present(F.col("Review")).alias("Review"),
                           _present(F.col("Rating")).alias("Rating"))


def read_ratings_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table of ``(review_id, Review, Rating)``; only these columns are read."""
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in RATINGS_FILE.fields])


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hand-labelled ``(review, aspect, true_label)`` rows; ``ValueError`` if a column is missing."""
    names = [f.name for f in GOLD_FILE.fields]
    return _required(_csv(spark, path), names, "gold file").select(*names)


def nonblank(reviews: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text holds more than white space."""
    return reviews.filter(F.col(text).rlike(r"[^ \t\n\r\f\x0b\x1c-\x1f]"))


def read_review_lines(spark: SparkSession, path: str) -> DataFrame:
    """One review per line of plain text."""
    return nonblank(spark.read.text(path).select(F.col("value").alias("text")))


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header that ``read_ratings_csv`` and ``read_gold_csv`` read back: quotes doubled, line breaks and blanks kept."""
    (table.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
