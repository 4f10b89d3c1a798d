"""Exact stratified splits that depend on the rows' ids only, not on their partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plateview.operators.joins import bounded
from plateview.operators.ratings import text_key
from plateview.schemas import MAX_CLASSES, SPLIT_SEED, TEST_SHARE, VALIDATION_SHARE

# Hash buckets per class: 16 ** 4. The cut of a class is searched in one bucket of them.
BUCKET_DIGITS = 4


def shuffle_key(id_col: Column, seed: int) -> Column:
    """Pseudo-random total order of the rows. Ids are unique, so buckets fill evenly even if texts repeat."""
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"))), id_col.cast("string"))


def class_quotas(sizes: DataFrame, held_out: float) -> DataFrame:
    """Rows of each class that stay in: ``(label, n, quota)`` from ``(label, n)``.

    The held-out part has ceil(share * total) rows; what stays in is allotted to the classes
    in proportion, by largest remainder (a tie goes to the smaller label). A class of one row cannot be split.
    """
    everyone = Window.partitionBy()
    exact = (bounded(sizes, MAX_CLASSES, "classes of a split")
             .withColumn("total", F.sum("n").over(everyone))
             .withColumn("stay", F.expr(f"total - cast(ceil(cast({held_out} as double) * total) as bigint)"))
             .withColumn("share", F.expr("cast(n as decimal(19,0)) * cast(stay as decimal(19,0))"))
             .withColumn("whole", F.expr("share div total"))
             .withColumn("part", F.expr("share % total"))
             .withColumn("rank", F.row_number().over(Window.orderBy(F.col("part").desc(), "label")))
             .withColumn("spare", F.col("stay") - F.sum("whole").over(everyone)))
    quota = F.col("whole") + (F.col("rank") <= F.col("spare")).cast("bigint")
    lonely = F.raise_error(F.concat(F.lit("class with a single row cannot be split: "), F.col("label").cast("string")))
    return exact.select("label", "n", F.when(F.col("n") >= 2, quota).otherwise(lonely.cast("bigint")).alias("quota"))


def _cuts(keyed: DataFrame, label_col: str, key: str, held_out: float, name: str) -> DataFrame:
    """Last key of each class that stays in: one row per class.

    A histogram over hash buckets finds the bucket that holds the cut; only that bucket's
    rows, one in 65,536, are ranked.
    """
    bucketed = keyed.select(F.col(label_col).alias("label"), F.col(key).alias("_key"),
                            F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"))
    histogram = bucketed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    quotas = class_quotas(histogram.groupBy("label").agg(F.sum("n").alias("n")), held_out)
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("_bucket"))
    boundary = (histogram.withColumn("upto", upto)
                .join(F.broadcast(quotas.select("label", "quota")), "label")
                .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
                .select("label", "_bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("_nth")))
    in_boundary = bucketed.join(F.broadcast(bounded(boundary, MAX_CLASSES, "classes of a split")), ["label", "_bucket"])
    ranked = in_boundary.withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("_key")))
    cuts = ranked.filter(F.col("_rank") == F.col("_nth")).select(F.col("label").alias(label_col), F.col("_key").alias(name))
    return bounded(cuts, MAX_CLASSES, "classes of a split")


def _stays(key: str, cut: str) -> Column:
    # A class whose quota is zero has no cut: none of its rows stay in.
    return F.coalesce(F.col(key) <= F.col(cut), F.lit(False))


def split_two_way(table: DataFrame, id_col: str, label_col: str, held_out: float = TEST_SHARE,
                  seed: int = SPLIT_SEED, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Adds ``split``: ``names[1]`` for exactly the held-out share of each class, else ``names[0]``.

    Three reads of the table (histogram, boundary bucket, assignment), the first two of the id and
    label only; no shuffle of the rows. Store a table that is costly to compute beforehand.
    """
    keyed = table.withColumn("_key", shuffle_key(F.col(id_col), seed))
    cuts = _cuts(keyed, label_col, "_key", held_out, "_cut")
    side = F.when(_stays("_key", "_cut"), names[0]).otherwise(names[1])
    return keyed.join(F.broadcast(cuts), label_col, "left").withColumn("split", side).select(*table.columns, "split")


def split_three_way(table: DataFrame, id_col: str, label_col: str, test: float = TEST_SHARE,
                    validation: float = VALIDATION_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``split``: the same test rows as ``split_two_way``; validation is a share of the rest."""
    keyed = (table.withColumn("_key", shuffle_key(F.col(id_col), seed))
             .withColumn("_key2", shuffle_key(F.col(id_col), seed + 1)))
    outer = keyed.join(F.broadcast(_cuts(keyed, label_col, "_key", test, "_cut")), label_col, "left")
    rest = outer.filter(_stays("_key", "_cut"))
    both = outer.join(F.broadcast(_cuts(rest, label_col, "_key2", validation, "_cut2")), label_col, "left")
    side = (F.when(~_stays("_key", "_cut"), "test")
            .when(_stays("_key2", "_cut2"), "train").otherwise("validation"))
    return both.withColumn("split", side).select(*table.columns, "split")


def stratified_folds(table: DataFrame, id_col: str, label_col: str, k: int, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``fold``, 0 to k - 1: of a class of n rows, fold j holds those from rank n * j // k on, up to n * (j + 1) // k, by the shuffle key.

    All k - 1 cuts of a class come from one histogram over hash buckets; only rows of the buckets that hold a cut are ranked. A class of fewer
    rows than folds leaves some folds without it. Rows of a NULL label are a class of their own.
    """
    if k < 2:
        raise ValueError("folds: at least two")
    keyed = table.withColumn("_key", shuffle_key(F.col(id_col), seed))
    bucketed = keyed.select(F.col(label_col).alias("label"), "_key", F.substring("_key", 1, BUCKET_DIGITS).alias("_bucket"))
    histogram = bucketed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("label")
    upto = histogram.withColumn("upto", F.sum("n").over(by_class.orderBy("_bucket"))).withColumn("_all", F.sum("n").over(by_class))
    cut = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.floor(F.col("_all") * j / k).cast("long"))
    held = F.filter(cut, lambda q: (q <= F.col("upto")) & (q > F.col("upto") - F.col("n")))
    wanted = upto.select("label", "_bucket", F.transform(held, lambda q: q - F.col("upto") + F.col("n")).alias("_nth")).filter(F.size("_nth") > 0)
    wanted = bounded(wanted, MAX_CLASSES * (k - 1), "cuts of the folds").withColumnRenamed("label", "_label").withColumnRenamed("_bucket", "_at")
    inside = bucketed.join(F.broadcast(wanted), F.col("label").eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_at")))
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy("label", "_bucket").orderBy("_key")))
    chosen = ranked.select("label", "_key", F.size(F.filter("_nth", lambda q: q == F.col("_rank"))).alias("_times")).filter(F.col("_times") > 0)
    cuts = chosen.groupBy("label").agg(F.collect_list(F.struct("_key", "_times")).alias("_cuts")).withColumnRenamed("label", "_label")
    sizes = histogram.groupBy(F.col("label").alias("_class")).agg(F.sum("n").alias("_all"))
    whole = sizes.join(cuts, F.col("_class").eqNullSafe(F.col("_label")), "left").drop("_label")
    # Cuts before the first row are passed by every row.
    early = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.floor(F.col("_all") * j / k)), lambda q: q == 0))
    whole = bounded(whole.select("_class", "_cuts", early.alias("_early")), MAX_CLASSES, "classes of a split")
    passed = F.aggregate(F.coalesce("_cuts", F.array().cast("array<struct<_key:string,_times:int>>")), F.lit(0),
                         lambda s, c: s + F.when(F.col("_key") > c["_key"], c["_times"]).otherwise(0))
    return (keyed.join(F.broadcast(whole), F.col(label_col).eqNullSafe(F.col("_class")), "left")
            .withColumn("fold", F.col("_early") + passed).select(*table.columns, "fold"))


def split_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def leaked_texts(table: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Texts that occur in more than one split: ``(text_key, n_splits, n_rows)``.

    One grouping over text hashes covers all pairs of splits; a bit per split keeps the state at one long.
    """
    bit = F.lit(0)
    for position, name in enumerate(names):
        bit = F.when(F.col("split") == name, F.lit(1 << position)).otherwise(bit)
    return (table.groupBy(text_key(F.col(text)).alias("text_key"))
            .agg(F.bit_or(bit).alias("_bits"), F.count(F.lit(1)).alias("n_rows"))
            .select("text_key", F.bit_count("_bits").cast("bigint").alias("n_splits"), "n_rows")
            .filter(F.col("n_splits") > 1))


def assert_no_leak(table: DataFrame, text: str, names: list[str]) -> None:
    leaks = leaked_texts(table, text, names).count()
    if leaks:
        raise ValueError(f"data leakage: {leaks} texts occur in more than one split")
