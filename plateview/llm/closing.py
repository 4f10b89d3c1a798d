"""All links inside buckets of candidates without comparing all their pairs.

Every bucket is a star first: one member, the hub, meets the others. For sets A and B let A' and B' be their symmetric
differences with the hub. |A' xor B'| = |A xor B|, so what a whole bucket has in common with its hub drops out of the
comparison. If A is not similar to the hub, it can be similar to B only if A' and B' share an element: the
hub's distance to A is above what a link allows, and sizes differ by no more than distances. So links that the star
leaves open are found by a join on the elements of the differences, rarest first, with the prefix and position bounds that
the needed overlap gives. Texts filled from one template, which mostly differ from it by words of their own, hardly ever meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from plateview.llm.components import confirmed, merged
from plateview.sources.scratch import stored

FEW_IDS = 1_000_000     # ids that are sent to the texts; counted before. More meet them in a sort-merge join


def whole_sets(texts: DataFrame, wanted: DataFrame, sets_of: Callable) -> DataFrame:
    """``(id, shingles)``, one row for each of the wanted classes ``(k1, k2, doc_id, id)`` of equal sets.

    ``texts(doc_id, text)`` are read again, those of the wanted documents only; ``sets_of`` turns batches of texts into (k1, k2, shingles).
    """
    few = wanted.count() <= FEW_IDS
    sent = F.broadcast(wanted) if few else wanted.hint("merge")
    own = texts.join(sent.select("doc_id"), "doc_id", "left_semi").select("text").mapInArrow(sets_of, "k1 long, k2 long, shingles array<long>")
    found = stored(own.join(F.broadcast(wanted) if few else wanted, ["k1", "k2"]).select("id", "shingles"), "sets")
    if found.count() > wanted.count():      # rows that repeat a doc_id
        found = stored(found.dropDuplicates(["id"]), "sets")
    return found


def _similar(both: Column, total: Column, percent: int) -> Column:
    return 100 * both >= percent * (total - both)


def stars(members: DataFrame) -> DataFrame:
    """Distinct ``(hub, id)`` for ``members(bucket, id)``: the hub is the member that is in the most buckets, the least id on a tie.

    Buckets with a common hub become one group; a group also holds its hub.
    """
    central = members.groupBy("id").agg(F.count(F.lit(1)).alias("central"))
    ranked = members.join(central, "id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("central", F.negative("id").alias("_i"), "id")).alias("c")).select("bucket", F.col("c.id").alias("hub"))
    return members.join(hubs, "bucket").select("hub", "id").distinct()


def distances(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(hub, id, size, hub_size, far, linked)``: elements by which a member differs from its hub, and whether the two are linked."""
    own = sets.select("id", F.col("shingles").alias("own"))
    centre = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("centre"))
    met = (groups.join(own, "id").join(centre, "hub")
           .select("hub", "id", F.size("own").alias("size"), F.size("centre").alias("hub_size"), F.size(F.array_intersect("own", "centre")).alias("both"),
                   (F.size(F.array_except("own", "centre")) + F.size(F.array_except("centre", "own"))).alias("far")))
    total = F.col("size") + F.col("hub_size")
    return met.select("hub", "id", "size", "hub_size", "far", _similar(F.col("both"), total, percent).alias("linked"))


def _ranked_differences(open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(hub, element, id, ..., rank)``: the elements of each difference that another member shares, by rarity within the group.

    Elements of one member only come first in every order; they are counted and not kept.
    """
    own = sets.select("id", F.col("shingles").alias("own"))
    centre = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("centre"))
    keep = ["hub", "id", "size", "hub_size", "far", "linked", "component"]
    apart = open_rows.join(own, "id").join(centre, "hub").select(
        *keep, F.explode(F.concat(F.array_except("own", "centre"), F.array_except("centre", "own"))).alias("element"))
    apart = stored(apart, "differences")
    common = apart.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    each = Window.partitionBy("hub", "id")
    return (apart.join(common, ["hub", "element"])
            .withColumn("_shared", F.count(F.lit(1)).over(each))
            .withColumn("_order", F.row_number().over(each.orderBy("df", "element")))
            .withColumn("rank", F.col("far") - F.col("_shared") + F.col("_order")).drop("_shared", "_order", "df"))


def candidates(ranked: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of different components that may be linked, one of them at least apart from the hub.

    With c = (100 - percent) / (100 + percent), sets are linked if they differ in at most c * (size + other size) elements, so
    differences must share (far + other far - that) / 2. The first shared element of B then has a rank
    below (far + c * (size - hub size)) / 2 + 1, and as many elements must follow it in both.
    """
    less, more = 100 - percent, 100 + percent
    some = ranked.filter(2 * more * F.col("rank") < more * F.col("far") + less * (F.col("size") - F.col("hub_size")) + 2 * more)
    other = ranked.filter(~F.col("linked")).select(
        "hub", "element", F.col("id").alias("a"), F.col("size").alias("_size"), F.col("far").alias("_far"), F.col("rank").alias("_rank"),
        F.col("component").alias("_component"))
    left = 1 + F.least(F.col("far") - F.col("rank"), F.col("_far") - F.col("_rank"))
    total = F.col("size") + F.col("_size")
    may = ((F.col("component") != F.col("_component")) & (2 * more * left >= more * (F.col("far") + F.col("_far")) - less * total)
           & (100 * F.least("size", "_size") >= percent * F.greatest("size", "_size")))
    return (some.join(other, ["hub", "element"]).filter(may)
            .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct())


def _with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """Without outsiders that no other member of the group is near enough to: distances of linked sets to the hub differ by no more than the sets."""
    near = Window.partitionBy("hub").orderBy("far", "id")
    gap = F.least(F.col("far") - F.lag("far").over(near), F.lead("far").over(near) - F.col("far"))
    # The other set has at most 100 / percent as many elements.
    within = (100 + percent) * percent * gap <= (100 - percent) * (100 + percent) * F.col("size")
    return rows.withColumn("_within", F.coalesce(within, F.lit(False))).filter(F.col("linked") | F.col("_within")).drop("_within")


def closed(members: DataFrame, sets: DataFrame, percent: int, links: DataFrame | None = None) -> DataFrame:
    """``parts(id, component)`` after all links between ``members(bucket, id)`` of a common bucket, and the given ones.

    ``sets(id, shingles)`` holds one set of distinct elements per id; ``links(a, b)`` are already known. Ids that nothing
    is linked to have no row. Members are compared with their hub, then as the differences demand, so a group of n linked to its
    hub costs n.
    """
    groups = stored(stars(members), "groups")
    star = stored(distances(groups, sets, percent), "stars")
    known = star.filter(F.col("linked")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    parts = merged(None, known if links is None else known.unionByName(links))
    named = star.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = named.groupBy("hub").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter(F.col("_a") != F.col("_b"))
    open_rows = stored(_with_partner(named.join(apart.select("hub"), "hub", "left_semi"), percent), "open")
    if open_rows.isEmpty():
        return parts
    ranked = stored(_ranked_differences(open_rows, sets), "ranked")
    pairs = stored(candidates(ranked, percent), "pairs")
    return merged(parts, confirmed(pairs, sets, percent))
