"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Words are runs of letters and digits in lower case. Wherever a common word (an anchor) stands, the
anchor and the next content words form a signature, so a fingerprint samples running prose and passes over
lists and menus. Fingerprints are compared by Jaccard similarity, which sets of very different length
need not be: they are partitioned by length, and share a bucket only if one of their rarest signatures agrees.
Built-in column functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plateview.functions.rows import settled
from plateview.llm.components import star_components
from plateview.sources.scratch import stored

CHAIN = 3                    # content words of a signature
BUCKET_ROWS = 2_000          # documents of a range of ids, about
MAX_BUCKETS = 1 << 14

# Frequent function words of English, German, French and Spanish.
ANCHORS = """a an and are as at be by for from has have he in is it not of on or she that the their they this to was were which with you
als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nicht sich sie sind so und von war wie zu
au avec ce cette dans de du elle en est et il ils je la le les mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous
al como con del el ella ellos entre era es esta este ha la las lo los más me muy no nos para pero por que se sin su sus una uno y ya""".split()


def anchor_pattern(anchors: list[str] | None = None) -> str:
    """A pattern of the space before an anchor, the alternatives grouped by first letter."""
    groups: dict[str, list[str]] = {}
    for word in sorted(set(anchors or ANCHORS)):
        groups.setdefault(word[0], []).append(word[1:])
    return " (?=(?:" + "|".join(f"{first}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for first, rest in sorted(groups.items())) + ") )"


def normalised(text: Column) -> Column:
    """Words in lower case between single spaces, with a space at either end; a space alone if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def signatures(table: DataFrame, keep: list[str], text: Column, name: str, anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """``keep`` columns and the distinct signatures of the text as a sorted array of 32-bit numbers.

    The text's beginning is an anchor too. A text without any anchor, or of anchors alone, makes every word one, so that it has more
    than a single signature; one without a word but not empty has itself as its only signature; an empty or NULL text none.
    """
    body = F.coalesce(text, F.lit(""))
    step = settled(table, keep, F.struct(normalised(text).alias("_n"), body.alias("_raw")))
    # "^" stands in for the anchor at the beginning.
    parts = F.split(F.concat(F.lit("^"), F.rtrim(F.col("_n")), F.lit(" ")), anchor_pattern(anchors))
    step = settled(step, [*keep, "_raw"], F.struct(F.transform(parts, lambda p: F.trim(p)).alias("_p"), F.col("_n").alias("_n")))
    words = F.split(F.trim("_n"), " ")
    alone = F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, chain), " "))
    step = settled(step, [*keep, "_raw", "_n", "_p"], F.struct(F.filter("_p", lambda p: F.instr(p, " ") > 0).alias("_f")))
    step = settled(step, [*keep, "_raw", "_n", "_p", "_f"], F.struct(
        F.transform("_f", lambda p: F.substring(p, F.instr(p, " ") + 1, F.length(p))).alias("_b")))
    chained = F.transform("_f", lambda p, i: F.hash(F.concat(F.substring_index(p, " ", 1), F.lit(":"), F.substring_index(
        F.array_join(F.slice("_b", i + 1, chain), " "), " ", chain))))
    single = F.transform(alone, lambda s: F.hash(s))
    found = (F.when(F.col("_raw") == "", F.array().cast("array<int>")).when(F.trim("_n") == "", F.array(F.hash("_raw")))
             .when((F.size("_p") > 1) & (F.size("_f") > 0), chained).otherwise(single))
    return settled(step, keep, F.struct(F.array_sort(F.array_distinct(found)).alias(name)))


def printed(signatures_: Column) -> Column:
    """A fingerprint as text: its signatures in order, eight hexadecimal digits each."""
    return F.array_join(F.transform(signatures_, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; two empty ones are equal."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the id, by binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")     # folded into one constant
    place = F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), place, lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.coalesce(F.try_element_at(held, at + s), F.lit(0)) <= doc_id), at + s).otherwise(at))


def with_next(documents: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, text, sigs, next_text, next_sigs)``: each document beside the next one by descending id, after the last the first.

    Ids fall into ranges of about equal size; a window orders each range, and the one document that begins the following
    range is looked up and broadcast: one text per range, at most ``MAX_BUCKETS``. Texts are shuffled once. A NULL id is the smallest;
    rows that repeat an id are ordered by a hash of their text.
    """
    smallest = -(1 << 63)
    base = documents.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(smallest)).alias("_id"), F.xxhash64("text").alias("_v"))
    ids = base.select("_id")
    n = ids.count()
    cuts = min(MAX_BUCKETS, n // bucket_rows)
    bounds = sorted({int(x) for x in ids.agg(F.percentile_approx("_id", [i / (cuts + 1) for i in range(1, cuts + 1)], 20 * (cuts + 1))).first()[0]}) if cuts else []
    # Settled, or the optimizer would infer from the join on it a filter of the other side by this side's ids, which cannot run.
    ranged = settled(base, base.columns, F.struct(_bucket(F.col("_id"), bounds).alias("_bucket")))
    # The first row of every range, by id and then by hash, is the next of the last row of the range above it.
    heads = ranged.groupBy("_bucket").agg(F.max(F.struct("_id", "_v")).alias("h"))
    order = Window.partitionBy().orderBy("_bucket")
    top = F.max(F.struct("_bucket", "h")).over(Window.partitionBy())["h"]
    after = heads.select("_bucket", F.coalesce(F.lag("h").over(order), top).alias("n")).select("_bucket", F.col("n._id").alias("_id"), F.col("n._v").alias("_v"))
    edges = stored(signatures(base.select("_id", "_v", "text").join(F.broadcast(after), ["_id", "_v"]).dropDuplicates(["_bucket"]),
                              ["_bucket", "text"], F.col("text"), "sigs"), "edges")
    edges = F.broadcast(edges.select("_bucket", F.struct(F.col("text").alias("text"), F.col("sigs").alias("sigs")).alias("_edge")))
    own = signatures(ranged, ["doc_id", "text", "_id", "_v", "_bucket"], F.col("text"), "sigs")
    below = F.lead(F.struct("text", "sigs")).over(Window.partitionBy("_bucket").orderBy(F.desc("_id"), F.desc("_v")))
    joined = own.withColumn("_below", below).join(edges, "_bucket")
    return joined.select("doc_id", "text", "sigs", F.coalesce("_below", "_edge").alias("_next")).select(
        "doc_id", "text", "sigs", F.col("_next.text").alias("next_text"), F.col("_next.sigs").alias("next_sigs"))


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """``(doc_id, sigs, fingerprint)`` of every row; equal texts have equal fingerprints."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_t"))
    return signatures(rows, ["doc_id"], F.col("_t"), "sigs", anchors, chain).withColumn("fingerprint", printed(F.col("sigs")))


def near_duplicates(documents: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, component_id)``: documents linked by fingerprints of a Jaccard similarity of ``percent`` or more.

    Equal fingerprints are one node. Of n signatures the n - ceil(percent n / 100) + 1 rarest are enough to meet every similar
    set; a set shares a bucket by such a signature with sets of its own length class and the next, none other can be
    similar. Buckets are compared by stars and confirmed on whole fingerprints, as for shingles. Empty fingerprints and rows
    without an id are linked with nothing.
    """
    prints = stored(fingerprints(documents, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "sigs", "fingerprint"), "prints")
    usable = prints.filter((F.size("sigs") > 0) & F.col("doc_id").isNotNull())
    nodes = stored(usable.groupBy(F.sha2("fingerprint", 256).alias("key")).agg(F.min("doc_id").alias("id")), "nodes")
    keyed = usable.select("doc_id", "sigs", F.sha2("fingerprint", 256).alias("key"))
    sets = stored(keyed.join(nodes, (keyed["key"] == nodes["key"]) & (F.col("doc_id") == F.col("id"))).select("id", F.col("sigs").alias("shingles")).distinct(), "sets")
    each = sets.select("id", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(counts, "s").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("order"))
    enough = (F.col("size") - F.ceil(F.col("size") * percent / 100.0) + 1).cast("int")
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100.0 / percent)) + 1e-9)
    prefix = rarest.select("id", "size", level.alias("level"), F.explode(F.slice("order", 1, enough)).alias("x"))
    members = prefix.select("id", "size", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"), "x.s")
    parts = star_components(members.select(F.xxhash64("s", "level").alias("bucket"), "id", "size"), sets, percent)
    whole = nodes.join(parts, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    return (prints.select("doc_id", F.when((F.size("sigs") > 0) & F.col("doc_id").isNotNull(), F.sha2("fingerprint", 256)).alias("key"))
            .join(whole, "key", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")))
