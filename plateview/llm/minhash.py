"""Near-duplicates by one-permutation MinHash with optimal densification.

A text's 5-word shingles are hashed once; the hash range is cut into bins, the smallest value of a
bin is its sketch, and an empty bin borrows from the first filled one on its own random route over the bins.
Bins in bands of eight make buckets, and a bucket's candidate edges form a star around one member. Links that the
star leaves open are found by what members differ from its centre in (``closing``). Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plateview.llm.buffers import NOT_SPACE, U64, Words, byte_column, chunks, mix, odd_powers
from plateview.llm.closing import closed, whole_sets
from plateview.llm.components import FEW  # noqa: F401
from plateview.sources.scratch import stored

SHINGLE = 5
BANDS, ROWS = 112, 8        # a link at similarity 0.75 shares no band once in 130,000 times
BINS = BANDS * ROWS
CHUNK_BYTES = 1 << 19

_routes: list[np.ndarray] = []


def _route() -> np.ndarray:
    """``[bin, other]``: at which step the route of an empty bin visits the other bin."""
    if not _routes:
        rng = np.random.default_rng(20240613)
        _routes.append(np.argsort(rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16))
    return _routes[0]


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    words = Words(data, ends, NOT_SPACE)
    factors = odd_powers(0xD6E8FEB86659FD93, size)
    grams = np.zeros(max(len(words.hash) - size + 1, 0), U64)
    for i in range(size):
        grams += words.hash[i: i + len(grams)] * factors[i]
    grams = mix(grams)
    for first, last in zip(words.bounds[:-1], words.bounds[1:]):
        if last - first >= size:
            own = np.sort(grams[first: last - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif last > first:
            short = (words.hash[first:last] * factors[: last - first]).sum(dtype=U64)
            yield mix(np.array([short + U64(last - first)], U64))
        else:
            yield np.zeros(0, U64)


_EDGES = (np.arange(BINS, dtype=object) * 2**64 // BINS).astype(U64)
_FACTORS = odd_powers(0xA24BAED4963EE407, ROWS + 1)[1:]


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band of a non-empty sorted set."""
    first = np.searchsorted(shingles, _EDGES)
    stop = np.concatenate([first[1:], [len(shingles)]])
    filled = stop > first
    sketch = shingles[np.minimum(first, len(shingles) - 1)]
    if not filled.all():
        have, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
        donor = have[_route()[empty][:, have].argmin(axis=1)]
        sketch[empty] = sketch[donor]
    banded = (sketch.reshape(BANDS, ROWS) * _FACTORS).sum(axis=1, dtype=U64)
    return mix(banded + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))


#: Two 64-bit names of a set.
NAMES = (lambda own: own.sum(dtype=U64), lambda own: (own * (own | U64(1))).sum(dtype=U64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = byte_column(batch.column(1))
        sizes, keys, other, bands = [], [], [], []
        for low, high in chunks(ends, CHUNK_BYTES):
            for own in shingle_sets(data[ends[low]: ends[high]], ends[low: high + 1] - ends[low]):
                sizes.append(len(own))
                keys.append(NAMES[0](own))
                other.append(NAMES[1](own))
                bands.append(bands_of(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()),
                                         pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(keys, U64).view(np.int64)),
             pa.array(np.array(other, U64).view(np.int64)), lists], names=["doc_id", "n_shingles", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = byte_column(batch.column(0))
        for low, high in chunks(ends, CHUNK_BYTES):
            sets = list(shingle_sets(data[ends[low]: ends[high]], ends[low: high + 1] - ends[low]))
            k1, k2 = (pa.array(np.array([f(s) for s in sets], U64).view(np.int64)) for f in NAMES)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([k1, k2, lists], names=["k1", "k2", "shingles"])


def sketches(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, bands)``: the size of the set, a 128-bit name of it, and its buckets."""
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_sketches, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def joined_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``parts(id, component)`` after all links inside buckets ``members(bucket, id)``, however crowded; ``sets`` has one set per id."""
    return closed(members.select("bucket", "id"), sets, percent)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    Two texts are linked if their shingle sets satisfy 100 * intersection >= percent * union;
    ``component_id`` is the smallest doc_id that links reach. Equal sets are one node from the start, so
    thousands of copies cost one. NULL, empty and blank texts have an empty set and stay alone. Rows
    that repeat a doc_id are one node. A row without doc_id is linked with nothing: its component is NULL.
    """
    table = stored(sketches(documents, doc_id, text), "sketches")
    usable = table.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("k1").alias("id")), "classes")
    if not classes.groupBy("k1").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).isEmpty():     # two sets of one 64-bit name
        classes = stored(classes.withColumn("id", F.xxhash64("k1", "k2")), "classes")
    own = usable.join(classes, ["k1", "k2", "doc_id"])
    rows = own.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    members = stored(rows.join(shared.filter(F.col("_a") != F.col("_b")).select("bucket"), "bucket"), "buckets")
    wanted = stored(classes.join(members.select("id").distinct(), "id", "left_semi"), "ids")
    texts = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sets = whole_sets(texts, wanted, _sets)
    # Rows that repeat a doc_id with another text put several sets under one document: its classes are linked.
    names = usable.select("doc_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "id"), ["k1", "k2"])
    several = names.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_b")).filter(F.col("a") != F.col("_b"))
    links = names.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b"))
    parts = closed(members, sets, percent, links)
    named = classes.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = named.join(named.groupBy("component").agg(F.min("doc_id").alias("_c")), "component").select("k1", "k2", "_c")
    return (table.select("doc_id", "n_shingles", "k1", "k2").join(whole, ["k1", "k2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("_c"))
                    .otherwise(F.col("doc_id")).alias("component_id")))


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, without those whose component has a smaller doc_id."""
    gone = (near_duplicates(documents, doc_id, text).filter(F.col("component_id") < F.col("doc_id"))
            .select(F.col("doc_id").alias("_gone")).distinct())
    return documents.join(gone, documents[doc_id].cast("long") == gone["_gone"], "left_anti")
