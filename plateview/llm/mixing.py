"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A pattern can be
used several times; each further use costs more, so repeats spread over the patterns before any is repeated
more often. The flow from patterns to source quotas is solved on the driver over the aggregated network;
documents are then chosen in a seeded order, by a histogram of hash buckets and not by a global sort, and a
few of them exchanged until each pattern meets its flow.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from plateview.sources.scratch import stored

REPEATS = 3
BUCKETS = 1 << 16
MAX_PATTERNS = 100_000       # the network that the driver solves; more patterns raise
WORD = r"[^\x20\x09-\x0D]+"


def water_filled(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Targets that share the sum of sizes by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    total, open_, targets = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: total * weights[i] / weight for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else share[i]
        total -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return targets


class _Flow:
    """Min-cost flow by successive cheapest paths (label-correcting search on the residual network)."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.room, self.cost = [], [], []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for node, other, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[node].append(len(self.to))
            self.to.append(other)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> None:
        while True:
            far, via, waiting, queued = {start: 0}, {}, deque([start]), {start}
            while waiting:
                node = waiting.popleft()
                queued.discard(node)
                for e in self.arcs[node]:
                    reach = far[node] + self.cost[e]
                    if self.room[e] > 0 and reach < far.get(self.to[e], 1 << 60):
                        far[self.to[e]], via[self.to[e]] = reach, e
                        if self.to[e] not in queued:
                            queued.add(self.to[e])
                            waiting.append(self.to[e])
            if end not in far:
                return
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def routed(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> dict:
    """``{(pattern, source): words}``: the cheapest way to fill as much of the quotas as the patterns can.

    Use number r of a pattern costs r * (r - 1) / 2 a word, so costs are convex in the repeats.
    """
    sources = list(quotas)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    end = 1 + len(patterns) + len(sources)
    flow, arcs = _Flow(end + 1), {}
    for i, (pattern, size) in enumerate(patterns):
        for r in range(1, repeats + 1):
            flow.arc(0, 1 + i, size, r * (r - 1) // 2)
        for s in dict.fromkeys(pattern):
            if s in place:
                arcs[i, s] = flow.arc(1 + i, place[s], repeats * size, 0)
    for s in sources:
        flow.arc(place[s], end, int(quotas[s]), 0)
    flow.run(0, end)
    return {(patterns[i][0], s): flow.room[e ^ 1] for (i, s), e in arcs.items() if flow.room[e ^ 1]}


def sized(documents: DataFrame, sources, text: str = "text", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """``(row, doc_id, pattern, size, draw, bucket)``: words of the text, the sorted distinct sources, a seeded order."""
    body = F.col(f"`{text}`")
    size = F.when(body.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))).cast("long")
    draw = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), body)
    table = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.sort_array(F.array_distinct(sources)).alias("pattern"),
                             size.alias("size"), draw.alias("draw"))
    return stored(table.select(F.monotonically_increasing_id().alias("row"), "*", F.pmod("draw", F.lit(BUCKETS)).cast("int").alias("bucket")), "sized")


def _totals(table: DataFrame, most: int) -> list[tuple[tuple, int]]:
    found = table.groupBy("pattern").agg(F.sum("size").alias("size")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} membership patterns")
    return sorted(((tuple(r.pattern or ()), int(r.size)) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])


def _plan_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("passes", T.LongType()), T.StructField("rest", T.LongType())])
    return spark.createDataFrame(rows, schema)


def _seeded(table: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``passes``, ``rest`` and ``on``: the first documents of each pattern in the seeded order that fit into the rest.

    A histogram over hash buckets finds the bucket in which the rest ends; only its documents are ranked.
    """
    sums = table.groupBy("_p", "bucket").agg(F.sum("size").alias("_s"))
    upto = sums.withColumn("_to", F.sum("_s").over(Window.partitionBy("_p").orderBy("bucket"))).join(plan, "_p")
    cuts = stored(upto.filter((F.col("_to") > F.col("rest")) & (F.col("_to") - F.col("_s") <= F.col("rest")))
                  .select("_p", F.col("bucket").alias("cut"), (F.col("rest") - F.col("_to") + F.col("_s")).alias("room")), "cuts")
    at_cut = table.join(F.broadcast(cuts), "_p").filter(F.col("bucket") == F.col("cut"))
    order = Window.partitionBy("_p").orderBy("draw", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    first = at_cut.withColumn("_to", F.sum("size").over(order)).filter(F.col("_to") <= F.col("room")).select("row", F.lit(True).alias("_in"))
    return (table.join(plan, "_p").join(F.broadcast(cuts.select("_p", "cut")), "_p", "left").join(first, "row", "left")
            .withColumn("on", (F.col("size") > 0) & F.coalesce((F.col("bucket") < F.col("cut")) | F.col("_in"), F.lit(False))).drop("cut", "_in"))


def mixed(table: DataFrame, patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS, rounds: int = 6) -> DataFrame:
    """``sized`` rows with ``copies`` and ``taken`` (words, repeats counted).

    All documents of a pattern are taken as often as whole passes fit into its flow. The rest is filled in the
    seeded order up to the first document that does not fit. Then one document at a time is added or left out, the one
    that brings the pattern nearest to its flow, for at most ``rounds`` rounds or until 0.1 % is met. Documents without
    words, sources or flow are taken 0 times; none more than ``repeats`` times. Equal rows are rows of
    their own. The order depends on seed, id and text alone.
    """
    spark = table.sparkSession
    flows: dict = {}
    for (pattern, _), words in routed(patterns, quotas, repeats).items():
        flows[pattern] = flows.get(pattern, 0) + words
    plan = _plan_table(spark, [(list(p), flows.get(p, 0) // size if size else 0, flows.get(p, 0) % size if size else 0) for p, size in patterns])
    # At most MAX_PATTERNS rows, here and in the tables made of them below.
    plan = F.broadcast(plan.withColumn("_p", F.xxhash64("pattern")).select("_p", "passes", "rest"))
    state = stored(_seeded(table.withColumn("_p", F.xxhash64("pattern")), plan), "seeded")
    used = state.groupBy("_p", "rest").agg(F.sum(F.when(F.col("on"), F.col("size")).otherwise(0)).alias("used"), F.sum("size").alias("size")).collect()
    gaps, slack = {r["_p"]: r["rest"] - r["used"] for r in used}, {r["_p"]: r["size"] // 1000 for r in used}
    flips: list[int] = []
    for _ in range(rounds):
        open_ = [(p, g) for p, g in gaps.items() if abs(g) > slack[p]]
        if not open_:
            break
        gap = F.broadcast(spark.createDataFrame(open_, "_p long, gap long"))
        now = F.col("on") != F.coalesce(F.col("_flip"), F.lit(False))
        tried = (_flipped(state, flips).join(gap, "_p").filter(F.col("size") > 0)
                 .withColumn("left", F.col("gap") + F.when(now, F.col("size")).otherwise(-F.col("size")))
                 .filter(F.abs("left") < F.abs("gap")))
        best = tried.groupBy("_p").agg(F.min(F.struct(F.abs("left").alias("off"), "draw", "doc_id", "row", "left")).alias("b")).collect()
        if not best:
            break
        for r in best:
            gaps[r["_p"]] = r.b.left
            flips = [x for x in flips if x != r.b.row] if r.b.row in flips else [*flips, r.b.row]
    extra = (F.col("on") != F.coalesce(F.col("_flip"), F.lit(False))).cast("int")
    copies = F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(0).cast("long")
    return _flipped(state, flips).select(*table.columns, copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _flipped(state: DataFrame, rows: list[int]) -> DataFrame:
    """Marks the rows whose choice was turned round: a few per pattern."""
    flips = state.sparkSession.createDataFrame([(r, True) for r in rows], "row long, _flip boolean")
    return state.join(F.broadcast(flips), "row", "left")


def mix_by_weight(documents: DataFrame, sources, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), text: str = "text",
                  doc_id: str = "doc_id", max_patterns: int = MAX_PATTERNS) -> tuple[DataFrame, dict, dict]:
    """The mix of all documents, the words of every source, and its target.

    Sources in code-point order, NULL last, weigh ``cycle`` in turn and share the words of all documents;
    a target stops at ``REPEATS`` times its source, the excess is shared again. Empty tables give no rows.
    """
    table = sized(documents, sources, text, doc_id)
    patterns = _totals(table, max_patterns)
    size: dict = {}
    for pattern, words in patterns:
        for s in pattern:
            size[s] = size.get(s, 0) + words
    names = sorted(size, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, water_filled([size[s] for s in names], [cycle[i % len(cycle)] for i in range(len(names))])))
    return mixed(table, patterns, {s: round(t) for s, t in targets.items()}), size, targets


def source_table(spark: SparkSession, sizes: dict, targets: dict) -> DataFrame:
    return spark.createDataFrame([(s, int(sizes[s]), float(targets[s])) for s in sizes], "source string, source_size long, target double")
