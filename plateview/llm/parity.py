"""Jaccard join of word shingles by parity sketches.

A text's parity sketch has one bit per hash position, toggled by each of its shingles that falls there, so two sketches differ in at
most as many bits as the sets differ in elements. Size bands fix how much a linked pair may differ: at most k elements for a pair
whose smaller set is in the band. The sketch of a band is cut into p > k blocks, so at least p - k blocks of a linked pair are
equal. Blocks are wide and nearly empty; they are held as the XOR of 64-bit names of their toggled positions.

The join is exact, with s = p - k. Of a block that few sets hold, all pairs are counted; a linked pair has s common blocks, so
it shares at least s less the number of common blocks that either of its sets could share besides. A pair that shares none of the
rare blocks has s common ones among the frequent: of a set's h frequent blocks, the h - s + 1 least frequent are buckets, closed by
``closing``. Empty blocks count as the most frequent of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plateview.llm.buffers import U64, byte_column, chunks, mix
from plateview.llm.closing import closed, whole_sets
from plateview.llm.components import confirmed
from plateview.llm.minhash import shingle_sets
from plateview.sources.scratch import stored

PERCENT = 80
GROWTH = 1.4                # the largest size of a band against its smallest
FEW = 8                     # holders of a block up to which their pairs are counted
COMMON = 64                 # holders beyond which blocks count as equally frequent
CHUNK_BYTES = 1 << 19
BATCH_BYTES = 1 << 23       # text whose blocks a task packs together
PART_CHARS = 1 << 24        # text per part of the blocks
PENDING = 4_000_000         # blocks that a task holds before it lets the common ones go

_EMPTY, _BAND_BITS = U64(1 << 55), U64(6)
_DOC, _PACKED, _PAIR, _HIGH, _BUCKET = range(5)
# Rows of documents; packed blocks; (band, shared, name, other name) of pairs; (band, h, name) of sets with frequent blocks; (bucket, -, name).
_COLUMNS = "kind int, part int, tokens binary, owners binary, holders binary, doc_id long, n_shingles long, k1 long, k2 long"


def _edges() -> np.ndarray:
    found = [1]
    while len(found) < 62:
        found.append(max(found[-1] + 1, int(found[-1] * GROWTH)))
    return np.array(found)


EDGES = _edges()


def allowed(percent: int) -> np.ndarray:
    """By band: the most elements in which a linked pair differs whose smaller set is in the band."""
    small = EDGES[1:] - 1
    large = small * 100 // percent
    return np.append((100 - percent) * (small + large) // (100 + percent), 0)


def blocks(percent: int) -> np.ndarray:
    """By band: blocks of a sketch; none where only equal sets are linked."""
    most = allowed(percent)
    return np.where(most > 0, most + 2 + most // 4, 0)


def bands_of(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands of a set's own size, and of the smallest size that it can be linked with."""
    return np.searchsorted(EDGES, sizes, side="right") - 1, np.searchsorted(EDGES, -(-percent * sizes // 100), side="right") - 1


def block_tokens(sets: list[np.ndarray], band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all blocks of each set's sketch for its band, and the number of the set that each belongs to.

    A name of 56 bits: 1 if the block is empty, 49 of the block's content, 6 of the band.
    """
    width = blocks(percent)[band]
    sizes = np.array([len(s) for s in sets], np.int64)
    held = np.concatenate(sets) if sets else np.zeros(0, U64)
    first = np.cumsum(width) - width
    each = np.repeat(np.arange(len(sets)), sizes)
    use = width[each] > 0
    held, each = held[use], each[use]
    slot = first[each] + (((held >> U64(32)) * width[each].astype(U64)) >> U64(32)).astype(np.int64)
    content = np.zeros(int(width.sum()), U64)
    if len(slot):
        begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        content[slot[begins]] = np.bitwise_xor.reduceat(held, begins)
    owner = np.repeat(np.arange(len(sets)), width)
    place = (np.arange(len(content)) - first[owner]).astype(U64) * U64(64) + band[owner].astype(U64)
    empty = content == 0
    name = mix(content + mix(place + U64(0x51ED2705))) >> U64(15)
    name = (name << _BAND_BITS) & (_EMPTY - U64(1)) | band[owner].astype(U64)
    return np.where(empty, name | _EMPTY, name), owner


def _seven(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _from_seven(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(U64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cut) if len(order) else []:
        yield int(part[own[0]]), own


def _rows(kind: int, part: np.ndarray, *columns) -> pa.RecordBatch:
    """Rows of up to four numbers."""
    n = len(part)
    none = pa.nulls(n, pa.binary())
    numbers = [c.cast(pa.int64()) if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) if c is not None else pa.nulls(n, pa.int64())
               for c in (*columns, None, None, None, None)[:4]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(part, np.int32)), none, none, none, *numbers],
                                      names=[c.split()[0] for c in _COLUMNS.split(", ")])


def _packed(parts: np.ndarray, token: np.ndarray, owner: np.ndarray, holders: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of many blocks, one for each part."""
    packed = [(p, _seven(token[i]), owner[i].tobytes(), None if holders is None else holders[i].astype(np.uint8).tobytes()) for p, i in _by_part(parts)]
    for low in range(0, len(packed), 64):
        some = list(zip(*packed[low: low + 64]))
        none = pa.nulls(len(some[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([_PACKED] * len(some[0]), pa.int32()), pa.array(some[0], pa.int32()),
                                          *(pa.array(x, pa.binary()) for x in some[1:]), none, none, none, none],
                                         names=[c.split()[0] for c in _COLUMNS.split(", ")])


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    return (mix(np.array([s.sum(dtype=U64) for s in sets], U64)), np.array([(s * (s | U64(1))).sum(dtype=U64) for s in sets], U64))


def _sketched(parts: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = byte_column(batch.column(1))
            for low, high in chunks(ends, BATCH_BYTES):
                sizes, one, two, tokens, owners = [], [], [], [], []
                seen: set[int] = set()
                for a, b in chunks(ends[low: high + 1], CHUNK_BYTES):
                    a, b = a + low, b + low
                    sets = list(shingle_sets(data[ends[a]: ends[b]], ends[a: b + 1] - ends[a]))
                    names, other = _names(sets)
                    sizes += [len(s) for s in sets]
                    one.append(names)
                    two.append(other)
                    fresh = [i for i, s in enumerate(sets) if len(s) and not (int(names[i]) in seen or seen.add(int(names[i])))]
                    if not fresh:
                        continue
                    sets, names = [sets[i] for i in fresh], names[fresh]
                    own, lower = bands_of(np.array([len(s) for s in sets]), percent)
                    for band, which in ((own, np.arange(len(sets))), (lower, np.flatnonzero(lower != own))):
                        token, owner = block_tokens([sets[i] for i in which], band[which], percent)
                        tokens.append(token)
                        owners.append(names[which][owner])
                one, two = (np.concatenate(x).view(np.int64) for x in (one, two))
                token = np.concatenate(tokens) if tokens else np.zeros(0, U64)
                owner = np.concatenate(owners) if owners else np.zeros(0, U64)
                yield _rows(_DOC, np.arange(len(one)) % parts, batch.column(0).slice(low, high - low), sizes, one, two)
                yield from _packed((mix(token) % U64(parts)).astype(np.int64), token, owner)
    return run


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    rows = batch.filter(pc.equal(batch.column("kind"), _PACKED))
    for token, owner, holders in zip(*(rows.column(c) for c in ("tokens", "owners", "holders"))):
        yield _from_seven(token.as_py()), np.frombuffer(owner.as_py(), U64), np.frombuffer(holders.as_py(), np.uint8) if holders.is_valid else None


def _passed(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.not_equal(batch.column("kind"), _PACKED))


def _distinct(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by token, and where each token begins."""
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    if len(token):
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner = token[fresh], owner[fresh]
    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return token, owner, begins


def _pairs(token: np.ndarray, owner: np.ndarray, begins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of holders of each block with few of them, and in how many blocks of which band they meet."""
    first, second, band = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for n in range(2, FEW + 1):
        at = begins[count == n]
        i, j = np.triu_indices(n, 1)
        first.append(owner[at[:, None] + i].reshape(-1))
        second.append(owner[at[:, None] + j].reshape(-1))
        band.append(np.repeat((token[at] & U64(63)).astype(np.int64), len(i)))
    first, second, band = map(np.concatenate, (first, second, band))
    order = np.lexsort((band, second, first))
    first, second, band = first[order], second[order], band[order]
    if not len(first):
        return first, second, band, band
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (band[1:] != band[:-1])]))
    return first[new], second[new], band[new], np.diff(np.append(new, len(first)))


def _counted(parts: int) -> Callable:
    """Counts the pairs that share a block of few holders, and tells the holders of other shared blocks how many they are, up to COMMON.

    A block is common once COMMON holders are seen; its further holders pass through, so a task holds COMMON owners of a
    block at most beyond the last PENDING rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, waiting = [np.zeros(0, U64)], [np.zeros(0, U64)], 0
        common, limit = np.zeros(0, U64), PENDING

        def told(token: np.ndarray, owner: np.ndarray, holders: np.ndarray) -> Iterator[pa.RecordBatch]:
            return _packed((owner % U64(parts)).astype(np.int64), token, owner, holders)

        for batch in batches:
            yield _passed(batch)
            for token, owner, _ in _unpacked(batch):
                if len(common):
                    known = common[np.minimum(np.searchsorted(common, token), len(common) - 1)] == token
                    if known.any():
                        yield from told(token[known], owner[known], np.full(int(known.sum()), COMMON))
                        token, owner = token[~known], owner[~known]
                tokens.append(token)
                owners.append(owner)
                waiting += len(token)
            if waiting >= limit:
                token, owner, begins = _distinct(np.concatenate(tokens), np.concatenate(owners))
                count = np.diff(np.append(begins, len(token)))
                gone = np.repeat(count, count) >= COMMON
                common = np.union1d(common, token[begins][count >= COMMON])
                yield from told(token[gone], owner[gone], np.full(int(gone.sum()), COMMON))
                tokens, owners = [token[~gone]], [owner[~gone]]
                waiting = len(tokens[0])
                limit = waiting + PENDING
        token, owner, begins = _distinct(np.concatenate(tokens), np.concatenate(owners))
        count = np.diff(np.append(begins, len(token)))
        each = np.repeat(count, count)
        yield from told(token[each > FEW], owner[each > FEW], np.minimum(each[each > FEW], COMMON))
        first, second, band, shared = _pairs(token, owner, begins, count)
        for low in range(0, len(first), 1 << 20):
            one, two, b, n = (x[low: low + (1 << 20)] for x in (first, second, band, shared))
            yield _rows(_PAIR, np.arange(len(one)) % parts, b, n, one.view(np.int64), two.view(np.int64))
    return run


def _chosen(percent: int) -> Callable:
    """The number of frequent blocks of each set, and the buckets of those that have enough to be linked by them alone.

    Two sets of one 64-bit name would count as one that has more frequent blocks, and keep more buckets, none less.
    """
    need = blocks(percent) - allowed(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, holders = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.uint8)]
        for batch in batches:
            yield _passed(batch)
            for token, owner, held in _unpacked(batch):
                tokens.append(token)
                owners.append(owner)
                holders.append(held)
        token, owner, held = map(np.concatenate, (tokens, owners, holders))
        band = (token & U64(63)).astype(np.int64)
        order = np.lexsort((token, held, token >= _EMPTY, band, owner))
        token, owner, band = token[order], owner[order], band[order]
        if not len(token):
            return
        # A common block is told again for each further copy of a set.
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner, band = token[fresh], owner[fresh], band[fresh]
        begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])]))
        count = np.diff(np.append(begins, len(token)))
        yield _rows(_HIGH, np.zeros(len(begins)), band[begins], count, owner[begins].view(np.int64))
        place = np.arange(len(token)) - np.repeat(begins, count)
        keep = place <= np.repeat(count, count) - need[band]
        token, owner = token[keep].view(np.int64), owner[keep].view(np.int64)
        for low in range(0, len(token), 1 << 20):
            some = token[low: low + (1 << 20)]
            yield _rows(_BUCKET, np.zeros(len(some)), some, None, owner[low: low + (1 << 20)])
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = byte_column(batch.column(0))
        for low, high in chunks(ends, CHUNK_BYTES):
            sets = list(shingle_sets(data[ends[low]: ends[high]], ends[low: high + 1] - ends[low]))
            one, two = _names(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["k1", "k2", "shingles"])


def _rare_pairs(table: DataFrame, percent: int) -> DataFrame:
    """Distinct ``(a, b)`` of sets that share a block of few holders, and with the frequent blocks of both enough to be linked."""
    need = F.array(*[F.lit(int(n)) for n in blocks(percent) - allowed(percent)])
    high = table.filter(F.col("kind") == _HIGH).select(F.col("doc_id").alias("band"), F.col("n_shingles").alias("h"), "k1")
    high = stored(high.groupBy("band", "k1").agg(F.max("h").alias("h")), "frequent")
    pairs = (table.filter(F.col("kind") == _PAIR).groupBy(F.col("doc_id").alias("band"), F.col("k1").alias("a"), F.col("k2").alias("b"))
             .agg(F.sum("n_shingles").alias("shared")))
    for side in ("a", "b"):
        own = high.select("band", F.col("k1").alias(side), F.col("h").alias(f"h_{side}"))
        pairs = pairs.join(own, ["band", side], "left").withColumn(f"h_{side}", F.coalesce(f"h_{side}", F.lit(0)))
    enough = F.col("shared") + F.least("h_a", "h_b") >= F.get(need, F.col("band").cast("int"))
    return pairs.filter(enough).select("a", "b").distinct()


def similar_sets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    Texts are linked if 100 * intersection >= ``percent`` * union of their distinct 5-word shingles; ``component_id`` is the
    smallest doc_id that links reach. Equal sets are one node, so copies cost one. NULL, empty and blank texts have an empty set
    and are linked with nothing. A row is judged by its own text, also where rows repeat a doc_id. A row without doc_id is
    linked with nothing; its component is NULL. An empty table gives no rows.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = max(8, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))
    sent = rows.mapInArrow(_sketched(8 * parts, percent), _COLUMNS).repartition(parts, "part")
    told = sent.mapInArrow(_counted(8 * parts), _COLUMNS).repartition(parts, "part")
    table = stored(told.mapInArrow(_chosen(percent), _COLUMNS).drop("part", "tokens", "owners", "holders"), "blocks")
    whole = table.filter(F.col("kind") == _DOC).drop("kind")
    usable = whole.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("k1").alias("id")), "classes")
    twice = classes.groupBy("k1").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    if not twice.isEmpty():     # two sets of one 64-bit name
        classes = stored(classes.withColumn("id", F.xxhash64("k1", "k2")), "classes")
    ids = classes.select("k1", "id")
    members = stored(table.filter(F.col("kind") == _BUCKET).select(F.col("doc_id").alias("bucket"), "k1").join(ids, "k1").select("bucket", "id"), "members")
    pairs = _rare_pairs(table, percent)
    pairs = (pairs.join(ids.select(F.col("k1").alias("a"), F.col("id").alias("_a")), "a").join(ids.select(F.col("k1").alias("b"), F.col("id").alias("_b")), "b")
             .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    pairs = stored(pairs, "pairs")
    wanted = members.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(wanted, "id", "left_semi"), "wanted")
    sets = whole_sets(rows, wanted, _sets)
    found = closed(members, sets, percent, confirmed(pairs, sets, percent))
    named = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", "component_id")
    return (whole.join(named, ["k1", "k2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id"))
                    .otherwise(F.col("doc_id")).alias("component_id")))
