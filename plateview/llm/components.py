"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plateview.sources.scratch import stored

FEW_LINKS = 500_000     # links that one task joins; counted before


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo") % F.lit(1 << 40))).first()
    return tuple(row)


def _joined_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over links of a measured, small number."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    ids = sorted(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names=["id", "component"])


def components(links: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``: the smallest id that can be reached.

    Counted links of at most ``few_links`` are joined by one task. More go through large-star and small-star steps
    until nothing changes: every step groups by node with map-side minima, and the join back on a hot node is an equi-join that
    can be split. Both give the same rows. Rows with a NULL end are no links; repeated links count once; no links
    give no rows.
    """
    now = stored(links.filter(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "links")
    if now.count() <= few_links:
        return stored(now.coalesce(1).mapInArrow(_joined_here, "id long, component long"), "parts")
    now, before = stored(now.distinct(), "links"), None
    while (state := _fingerprint(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        nearest = both.groupBy("hi").agg(F.min("lo").alias("least")).select("hi", F.least("hi", "least").alias("least"))
        large = (both.select("hi", F.col("lo").alias("other")).join(nearest, "hi").filter(F.col("other") > F.col("hi"))
                 .filter(F.col("other") != F.col("least")).select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct())
        nearest = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (large.join(nearest, "hi").filter(F.col("lo") != F.col("least"))
                 .select(F.col("lo").alias("hi"), F.col("least").alias("lo")))
        now = stored(small.unionByName(nearest.select("hi", F.col("least").alias("lo"))).distinct(), "links")
    tops = now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "id")
    return stored(tops.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()), "parts")


FEW = 64    # members outside a bucket's least component, or components of a bucket, that are compared at once


def renamed(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members with their present component, the least id linked to them so far."""
    plain = members.drop("component", "least", "n", "others", "k")
    if parts is None:
        return plain.withColumn("component", F.col("id"))
    return plain.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))


def open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the ``least`` one, ``n`` members, ``others`` outside the least, ``k`` components."""
    each = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    whole = each.groupBy("bucket").agg(F.min(F.struct("component", "c")).alias("m"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return members.join(whole.filter(F.col("k") > 1).select(
        "bucket", F.col("m.component").alias("least"), "n", (F.col("n") - F.col("m.c")).alias("others"), "k"), "bucket")


def linked(members: DataFrame, centres: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between centres and members of their buckets in other components, confirmed on whole sets."""
    hub = centres.select("bucket", F.col("id").alias("a"), F.col("size").alias("_size"), F.col("component").alias("_component"))
    pairs = (members.join(hub, "bucket").filter((F.col("component") != F.col("_component")) & sizes_allow("size", "_size", percent))
             .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct())
    return confirmed(pairs, sets, percent)


def sizes_allow(one: str, other: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar; an unknown size rules nothing out."""
    return F.coalesce(100 * F.least(one, other) >= percent * F.greatest(one, other), F.lit(True))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough."""
    met = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
           .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
           .select("a", "b", F.size(F.array_intersect("left", "right")).alias("both"), (F.size("left") + F.size("right")).alias("total")))
    return met.filter(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b")


def merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """``parts(id, component)`` after further links: a component so far is a star of links to its least id."""
    return components(links if parts is None else links.unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def hubs(now: DataFrame) -> DataFrame:
    """The least member of the least component of each bucket."""
    return (now.filter(F.col("component") == F.col("least")).groupBy("bucket")
            .agg(F.min(F.struct("id", "size", "component")).alias("c")).select("bucket", "c.*"))


def centres(now: DataFrame) -> DataFrame:
    """About sqrt(n) members outside the least component of each bucket, by a hash of their id."""
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("n"))).alias("_slot")
    return (now.filter(F.col("component") != F.col("least")).groupBy("bucket", slot)
            .agg(F.max(F.struct("component", "id", "size")).alias("c")).select("bucket", "c.*"))


def star_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(id, component)`` of what is linked among ``members(bucket, id, size)`` by sets ``(id, shingles)`` of ``percent`` similarity.

    Ids that nothing is linked to have no row. Every bucket is first a star: one member of its least component against
    all others, so a bucket of n gives n - 1 pairs. Of what then still lies outside the bucket's least component, up to 64 members, or
    else sqrt(n), are compared with the whole bucket. A centre has met all its bucket and leaves; the loop ends
    when no bucket holds two components, so no link inside a bucket is lost.
    """
    now, parts = stored(open_buckets(renamed(members, None).distinct()), "members"), None
    while not now.isEmpty():
        parts = merged(parts, linked(now.filter(F.col("component") != F.col("least")), hubs(now), sets, percent))
        now = stored(open_buckets(renamed(now, parts)), "members")
        if now.isEmpty():
            break
        few = now.filter((F.col("component") != F.col("least")) & (F.col("others") <= FEW)).select("bucket", "component", "id", "size")
        chosen = stored(few.unionByName(centres(now.filter(F.col("others") > FEW))), "centres")
        parts = merged(parts, linked(now, chosen, sets, percent))
        rest = now.filter(F.col("others") > FEW).join(chosen.select("bucket", "id"), ["bucket", "id"], "left_anti")
        now = stored(open_buckets(renamed(rest, parts)), "members")
    return parts if parts is not None else members.limit(0).select("id", F.col("id").alias("component"))


def closed(members: DataFrame, sets: DataFrame, percent: int, parts: DataFrame | None) -> DataFrame | None:
    """``parts(id, component)`` after all links between ``members(bucket, id, size)`` of a common bucket.

    In every bucket, members outside its largest component are centres: all of them if they are up to ``FEW``, otherwise a share
    of about 1/sqrt(n) by a hash of the id, four times as many in each further round. A centre meets all its bucket and leaves;
    the loop ends when no bucket holds two components. The hash does not depend on the bucket, so texts that
    share many buckets mostly meet in one round, where a pair is compared once.
    """
    now, reach = members.select("bucket", "id", "size").distinct(), 1
    while True:
        now = renamed(now, parts)
        each = now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
        whole = each.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
        found = now.join(whole.filter(F.col("k") > 1), "bucket")
        drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(reach << 20) / F.sqrt("n")
        centre = (F.col("component") != F.col("m.component")) & ((F.col("n") - F.col("m.c") <= FEW) | drawn)
        now = stored(found.select("bucket", "id", "size", "component", centre.alias("centre")), "members")
        if now.isEmpty():
            return parts
        hub = now.filter("centre").select("bucket", F.col("id").alias("a"), F.col("size").alias("_size"), F.col("component").alias("_component"))
        pairs = now.join(hub, "bucket").filter((F.col("component") != F.col("_component")) & (~F.col("centre") | (F.col("a") < F.col("id")))
                                               & sizes_allow("size", "_size", percent))
        links = confirmed(pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), sets, percent)
        parts, reach = merged(parts, links), 4 * reach
        now = now.filter(~F.col("centre")).select("bucket", "id", "size")
