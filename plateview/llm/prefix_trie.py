"""The trie of conversations that begin alike: what each shared beginning saves.

A node is a distinct sequence of first turns. Its name is the XOR of a 128-bit hash of each (depth, turn), so that a running
window names all beginnings of a conversation and no text is shuffled. Nodes are counted by name. Sums over subtrees come from a
balanced-parentheses encoding: one path for each childless node, in the order of the names along it, cut into shards. A shard writes its paths as
parentheses and keeps the excess of open ones with block minima; ``findclose`` delimits a subtree, the rank of pairs ``()`` counts its
childless nodes and cumulative arrays its savings. A node on paths of several shards, a shared spine, has its parts merged; what
neighbouring shards share weighs in the first of them only. Paths are cut into layers, so no row grows with a
conversation's length; the sums at the top of a layer are weights at the bottom of the one above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plateview.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
LAYER = 4096                # turns of a path in one row
SHARD = 400_000             # turns of all paths of a shard
BLOCK = 64                  # parentheses in a block of the excess index
ENDS = 4096                 # range of conversation ids that are joined in one row
KEY = ["depth", "k1", "k2"]


def turn_digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, place, t1, t2, words)``: place of each turn from 1, a 128-bit name of role and text, and the words of the text.

    NULL role or text is empty. Turns are ordered by ``turn``, NULL first, ties by their names. Rows without conv_id belong to no conversation.
    """
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    name = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    rows = (conversations.filter(F.col(f"`{conv_id}`").isNotNull())
            .select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"), name.alias("_m"),
                    F.regexp_count(said, F.lit(WORD)).cast("long").alias("words")))
    halves = [F.conv(F.substring("_m", at, 16), 16, -10).cast("long") for at in (1, 17)]
    rows = rows.select("conv_id", "_turn", halves[0].alias("t1"), halves[1].alias("t2"), "words")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "t1", "t2"))
    return rows.select("conv_id", place.alias("place"), "t1", "t2", "words")


def with_borrowed_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the first turns of another, and ``(conv_id)`` of all of them.

    Conversation c takes the first h turns of conversation c - c % ``every`` and then its own turns after its first h, with
    h = crc32 of its decimal id, modulo ``most``.
    """
    turns = stored(turns, "digests")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)
    convs = turns.select("conv_id").distinct()
    heads = turns.filter(F.col("place") < most).withColumnRenamed("conv_id", "_from")
    borrowed = (convs.withColumn("_from", F.col("conv_id") - F.col("conv_id") % F.lit(every)).join(heads, "_from").filter(F.col("place") <= h)
                .select("conv_id", "place", "t1", "t2", "words"))
    return borrowed.unionByName(turns.filter(F.col("place") > h)), convs


def _beginnings(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2, q1, q2, words, last)``: the name of each beginning and of the one a turn shorter."""
    own = Window.partitionBy("conv_id").orderBy("place")
    placed = turns.select("conv_id", "place", "t1", "t2", "words", F.row_number().over(own).alias("depth"))
    mixed = placed.select("conv_id", "place", "depth", "words", F.xxhash64("t1", "t2", "depth", F.lit(1)).alias("h1"),
                          F.xxhash64("depth", "t2", F.lit(2), "t1").alias("h2"))
    whole = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = mixed.select("conv_id", "place", "depth", "words", F.bit_xor("h1").over(whole).alias("k1"), F.bit_xor("h2").over(whole).alias("k2"))
    return named.select("conv_id", "depth", "k1", "k2", F.coalesce(F.lag("k1").over(own), F.lit(0)).alias("q1"),
                        F.coalesce(F.lag("k2").over(own), F.lit(0)).alias("q2"), "words", F.lead("k1").over(own).isNull().alias("last"))


def _nodes(begins: DataFrame, convs: DataFrame) -> DataFrame:
    """``(depth, k1, k2, conv_id, n_convs, words, q1, q2, n_children)``, the root at depth 0 included."""
    none = F.lit(None).cast("long")
    own = begins.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"),
                                   F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    own = stored(own, "beginnings")
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter(F.col("conv_id").isNotNull())
            .select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", "n_convs",
                    F.lit(0).cast("long").alias("words"), none.alias("q1"), none.alias("q2")))
    above = own.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    facts = ["conv_id", "n_convs", "words", "q1", "q2"]
    rows = (own.unionByName(root).withColumn("n_children", F.lit(0).cast("long"))
            .unionByName(above.select(*KEY, *[none.alias(c) for c in facts], "n_children")))
    return stored(rows.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in facts], F.sum("n_children").alias("n_children")), "nodes")


def _ends(begins: DataFrame, convs: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)``: the hash of the ids of the conversations that end at a node, in ascending order.

    Ranges of ids are joined in parallel; one pass over a node's few ranges hashes them in order.
    """
    last = begins.filter("last").select(*KEY, "conv_id")
    turnless = convs.join(last.select("conv_id"), "conv_id", "left_anti").select(
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    ranges = (last.unionByName(turnless).groupBy(*KEY, F.floor(F.col("conv_id") / F.lit(ENDS)).alias("range"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))
    return ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range").drop("range").mapInArrow(
        _hashed, "depth int, k1 long, k2 long, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield _ended(done)
            done = []
    if now is not None:
        yield _ended([(*now, state.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    depth, k1, k2, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digest)],
                                      names=[*KEY, "ends_sha256"])


class Parentheses:
    """Balanced parentheses with minima of the excess of open ones by block, and a tree of minima over the blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = max(1, -(-len(bits) // block))
        size = 1 << (blocks - 1).bit_length()
        self.padded = np.full(size * block, np.iinfo(np.int64).max)
        self.padded[: len(bits)] = self.excess
        self.minima = [self.padded.reshape(size, block).min(axis=1)]
        while len(self.minima[-1]) > 1:
            self.minima.append(self.minima[-1].reshape(-1, 2).min(axis=1))
        self.opens = np.flatnonzero(bits)
        pair = np.zeros(len(bits), np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.rank_pair = np.concatenate([[0], np.cumsum(pair)])      # pairs () that begin before a place
        self.rank_open = np.concatenate([[0], np.cumsum(bits)])      # open ones before a place

    def _first_below(self, start: np.ndarray, level: np.ndarray, steps: int) -> np.ndarray:
        """First place from ``start`` within its block of an excess below ``level``; -1 if there is none."""
        found, left = np.full(len(start), -1), np.arange(len(start))
        for step in range(steps):
            at = start[left] + step
            inside = at // self.block == start[left] // self.block
            left, at = left[inside], at[inside]
            hit = self.padded[at] < level[left]
            found[left[hit]] = at[hit]
            left = left[~hit]
            if not len(left):
                break
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The place that closes each open parenthesis."""
        level = self.excess[at]
        close = self._first_below(at, level, self.block)
        far = np.flatnonzero(close < 0)
        if not len(far):
            return close
        node, height, open_ = at[far] // self.block, np.full(len(far), -1), np.arange(len(far))
        for h, row in enumerate(self.minima[:-1]):      # up to the first right neighbour that holds the place
            here = node[open_]
            hit = (here % 2 == 0) & (row[np.minimum(here + 1, len(row) - 1)] < level[far[open_]])
            node[open_[hit]] += 1
            height[open_[hit]] = h
            open_ = open_[~hit]
            node[open_] //= 2
        for h in range(len(self.minima) - 1, 0, -1):    # and down to its block
            down = np.flatnonzero(height == h)
            left = 2 * node[down]
            node[down] = np.where(self.minima[h - 1][left] < level[far[down]], left, left + 1)
            height[down] = h - 1
        close[far] = self._first_below(node * self.block, level[far], self.block)
        return close


def shard_sums(names: np.ndarray, length: np.ndarray, saved: np.ndarray, leaves: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, as places in the flat table of paths, with the childless nodes and savings of their subtrees.

    Paths are sorted; ``names`` has two columns. The first ``shared`` nodes of the first path are also on a path before it and weigh nothing here.
    """
    first = np.cumsum(length) - length
    common = np.zeros(len(length), np.int64)
    for i in range(1, len(length)):
        n = min(length[i - 1], length[i])
        differ = np.flatnonzero((names[first[i - 1]: first[i - 1] + n] != names[first[i]: first[i] + n]).any(axis=1))
        common[i] = differ[0] if len(differ) else n
    closes = np.append(0, length[:-1]) - common
    closes[:1] = 0
    turns = np.stack([closes, length - common], axis=1).reshape(-1)
    bits = np.append(np.repeat(np.tile([0, 1], len(length)), turns), np.zeros(int(length[-1:].sum()), np.int64)).astype(np.int8)
    place = np.arange(len(names)) - np.repeat(first, length)
    own = np.flatnonzero(place >= np.repeat(common, length))     # one open parenthesis each, in order
    tree = Parentheses(bits)
    close = tree.findclose(tree.opens)
    weight = saved[own].copy()
    weight[:shared] = 0
    total = np.concatenate([[0], np.cumsum(weight)])
    childless = own[tree.rank_pair[tree.opens + 1] > tree.rank_pair[tree.opens]]
    ended = np.concatenate([[0], np.cumsum(leaves[childless])])
    return (own, ended[tree.rank_pair[close]] - ended[tree.rank_pair[tree.opens]],
            total[tree.rank_open[close]] - total[tree.rank_open[tree.opens]])


def _sums(shard: pa.Table) -> pa.Table:
    paths = sorted(zip(*(shard.column(c).to_pylist() for c in ("before", "path"))), key=lambda r: (not r[0], [(x["k1"], x["k2"]) for x in r[1]]))
    before = [p for flag, p in paths if flag]
    paths = [p for flag, p in paths if not flag]
    flat = [x for p in paths for x in p]
    shared = 0
    if before and paths:
        for x, y in zip(before[-1], paths[0]):
            if (x["k1"], x["k2"]) != (y["k1"], y["k2"]):
                break
            shared += 1
    columns = {c: np.array([x[c] for x in flat], np.int64) for c in ("depth", "k1", "k2", "saved", "leaves")}
    names = np.stack([columns["k1"], columns["k2"]], axis=1).reshape(-1, 2)
    own, n, saved = shard_sums(names, np.array([len(p) for p in paths], np.int64), columns["saved"], columns["leaves"], shared)
    return pa.table({"depth": pa.array(columns["depth"][own], pa.int32()), "k1": columns["k1"][own], "k2": columns["k2"][own],
                     "n_leaves": n.astype(np.int64), "saved_tokens": saved.astype(np.int64)})


def _layer_sums(nodes: DataFrame, begins: DataFrame, layer: int, size: int, below: DataFrame | None, shard: int) -> DataFrame:
    """``(depth, k1, k2, n_leaves, saved_tokens)`` of the nodes of a layer and of those it hangs from, from this layer and those below."""
    low, high = layer * size, (layer + 1) * size
    here = (F.col("depth") > low) & (F.col("depth") <= high)
    own = nodes.filter(here).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    own = own.select(*KEY, "conv_id", "n_children", "saved", F.lit(1).cast("long").alias("leaves"))
    if below is not None:       # what hangs from the last depth weighs there
        own = (own.join(below.select(*KEY, F.col("n_leaves").alias("_n"), F.col("saved_tokens").alias("_s")), KEY, "left")
               .withColumn("saved", F.col("saved") + F.coalesce("_s", F.lit(0))).withColumn("leaves", F.coalesce("_n", "leaves")).drop("_n", "_s"))
    tips = own.filter((F.col("n_children") == 0) | (F.col("depth") == high)).select("conv_id", F.col("depth").alias("_tip"))
    turns = begins.filter(here).join(tips, "conv_id").filter(F.col("depth") <= F.col("_tip")).select("conv_id", *KEY, "q1", "q2")
    turns = turns.join(own.select(*KEY, "saved", "leaves"), KEY)
    step = F.struct("depth", "k1", "k2", "saved", "leaves")
    top = F.struct(F.lit(low).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.lit(0).cast("long").alias("saved"),
                   F.lit(0).cast("long").alias("leaves"))
    steps = turns.select("conv_id", step.alias("x")).unionByName(turns.filter(F.col("depth") == low + 1).select("conv_id", top.alias("x")))
    paths = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("path"))
    paths = stored(paths.withColumn("order", F.transform("path", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2")))), "paths")
    held = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    sharded = paths.repartitionByRange(max(1, -(-int(held) // shard)), "order").withColumn("shard", F.spark_partition_id())
    sharded = stored(sharded.select("shard", "path", "order"), "shards")
    last = sharded.groupBy("shard").agg(F.max(F.struct("order", "path")).alias("m"))     # one row a shard
    before = (last.select("shard", F.lag("m.path").over(Window.orderBy("shard")).alias("path"))
              .filter(F.col("path").isNotNull()).select("shard", "path", F.lit(True).alias("before")))
    rows = sharded.select("shard", "path", F.lit(False).alias("before")).unionByName(before)
    found = rows.groupBy("shard").applyInArrow(_sums, "depth int, k1 long, k2 long, n_leaves long, saved_tokens long")
    return stored(found.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")


def prefix_trie(turns: DataFrame, convs: DataFrame, layer: int = LAYER, shard: int = SHARD) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, a row for each node.

    ``turns(conv_id, place, t1, t2, words)`` as ``turn_digests`` gives them, ``convs(conv_id)`` all conversations, also those
    without turns. ``conv_id`` is the smallest member of a node, those of its conversations that begin with it; ``n_leaves`` counts childless nodes
    in its subtree, itself included, ``saved_tokens`` adds up (members - 1) * words of the last turn over the subtree, ``ends_sha256``
    hashes the ids of the members that end there. The root, of depth 0, has no parent and no last turn. Without conversations there are no rows.
    """
    convs = stored(convs.distinct(), "convs")
    begins = stored(_beginnings(turns), "turns")
    nodes = _nodes(begins, convs)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    none = F.lit(None).cast("long")
    sums = [nodes.filter((F.col("depth") == 0) & (F.col("n_children") == 0))
            .select(*KEY, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))]
    below = None
    for at in range(max(0, (deepest - 1) // layer) if deepest else -1, -1, -1):
        found = _layer_sums(nodes, begins, at, layer, below, shard)
        sums.append(found.filter((F.col("depth") > at * layer) | (F.col("depth") == 0)))
        below = found.filter(F.col("depth") == at * layer)
    facts = ["conv_id", "n_convs", "n_children", "q1", "q2"]
    rows = nodes.select(*KEY, *facts, none.alias("n_leaves"), none.alias("saved_tokens"), F.lit(None).cast("string").alias("ends_sha256"))
    for one in sums:
        rows = rows.unionByName(one.select(*KEY, *[none.alias(c) for c in facts], "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256")))
    rows = rows.unionByName(_ends(begins, convs).select(*KEY, *[none.alias(c) for c in [*facts, "n_leaves", "saved_tokens"]], "ends_sha256"))
    whole = rows.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in [*facts, "n_leaves", "saved_tokens", "ends_sha256"]])
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return (whole.join(above, ["depth", "q1", "q2"], "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
