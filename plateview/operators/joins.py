"""Joins with lookup tables, and tables whose size is proven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bounded(table: DataFrame, max_rows: int, what: str) -> DataFrame:
    """The table, proven to have at most ``max_rows`` rows: the job fails if it has more.

    The limit stops one row past the bound, so neither the check nor a broadcast of the
    result can grow with the data. The check is a filter on the count, which stays whatever columns
    are read, so nothing is ever cut in silence.
    """
    counted = table.limit(max_rows + 1).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy()))
    too_many = F.raise_error(F.lit(f"{what}: more than {max_rows} rows")).cast("boolean")
    return counted.filter(F.when(F.col("_rows") <= max_rows, F.lit(True)).otherwise(too_many)).drop("_rows")


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``facts`` to a table with few rows per key; the strategy follows from measured bytes.

    A stored lookup has its true size, a computed one is measured when its shuffle is done. Below the broadcast
    threshold of the session it is broadcast; above it both sides are shuffled, and the adaptive join splits
    keys that hold too many facts into as many tasks as their bytes need.
    """
    return facts.join(lookup, keys, how)


# --- a small table as one value that every row can look things up in ----------------------

def lookup_value(table: DataFrame, key: str, value: Column, slots: int) -> Column:
    """An array of ``slots`` small maps from key to value, by hash of the key. Only for tables of a known, small size."""
    entry = F.struct(F.col(key).alias("key"), value.alias("value"))
    filled = table.groupBy(F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot")).agg(F.collect_list(entry).alias("entries"))
    none = F.array().cast(filled.schema["entries"].dataType)
    every = table.sparkSession.range(slots).withColumnRenamed("id", "slot")
    whole = every.join(filled, "slot", "left").withColumn("entries", F.coalesce("entries", none))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "entries"))),
                                 lambda s: F.map_from_entries(s["entries"]))).scalar()


def looked_up(held: Column, key: Column, slots: int) -> Column:
    """The value of a key in a ``lookup_value``; NULL if it is not there."""
    return F.try_element_at(F.get(held, F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")), key)
