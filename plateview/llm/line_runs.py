"""Repeated runs of lines, by a distributed suffix array over line ids, and their removal.

Every document is a sequence of line ids. Prefix doubling ranks the suffixes by their first 1, 2, 4, ...
lines: a round joins the rank at a place with the rank that many lines further, sorts the distinct
pairs over range partitions and numbers them. A suffix whose prefix nobody shares is in its final place and
drops out, so rounds shrink to what is repeated, and doubling ends when no prefix is shared. Suffixes of equal rank are a
longest-common-prefix interval; going back through the ranks, from the longest prefixes to single lines, gives each suffix
the exact length of the longest run that begins at it and also at an earlier place, and that place. Runs that lie in no other
are the maximal ones; those of enough lines or words are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plateview.llm.columns import set_aside
from plateview.sources.scratch import stored

MIN_LINES = 3                # a repeated run of so many lines goes,
MIN_WORDS = 50               # or of so many words on fewer lines
KEY = ["doc", "version"]     # a document's id, and a hash of its text should an id occur twice
PLACE = [*KEY, "pos"]
STATE = [*PLACE, "depth", "kind", "first"]
BOTH, ANY, APART, FIRST = range(4)     # a state holds for both kinds of earlier place, for overlapping or for other ones; or stands for a first place


def _identified(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    last = F.lit((1 << 63) - 1)
    return documents.withColumns({"_doc": F.coalesce(F.col(f"`{doc_id}`").cast("long"), last),
                                  "_version": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})


def line_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, version, pos, line_no, words, rank)``: lines that hold more than white space, numbered from 0 without the others."""
    lines = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("line"))),
                     lambda x: x["line"].rlike(r"\S"))
    return (_identified(documents, doc_id, text)
            .select(F.col("_doc").alias("doc"), F.col("_version").alias("version"), F.posexplode(lines).alias("pos", "x"))
            .select(*PLACE, "x.line_no", F.regexp_count("x.line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.xxhash64("x.line").alias("rank")))


def _shared(suffixes: DataFrame, by: list[str], name: str) -> DataFrame:
    """The suffixes whose ``by`` occurs more than once, with an order-preserving number of it as ``rank``; repeated rows once."""
    keys = suffixes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*by)
    numbered = stored(keys.orderBy(*by).withColumn("_rank", F.monotonically_increasing_id()), f"ranks-{name}")
    others = [c for c in suffixes.columns if c not in by and c != "rank"]
    found = suffixes.join(numbered, by).select(*others, F.col("_rank").alias("rank"))
    return stored(found.distinct() if name == "1" else found, f"suffixes-{name}")


def _extended(suffixes: DataFrame, by: int) -> DataFrame:
    """Each suffix with the rank found ``by`` lines further on; those without one share no longer prefix."""
    ahead = suffixes.select(*KEY, (F.col("pos") - by).alias("pos"), F.col("rank").alias("next"))
    return suffixes.select(*PLACE, "rank").join(ahead, PLACE)


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Per power of two, until none is left, the suffixes that share so many first lines with another.

    ``rank`` orders them by these lines, and line ids stand in the order of their hashes. The first table keeps all columns of ``lines``.
    """
    levels, now = [], _shared(lines, ["rank"], "1")
    while not now.isEmpty():
        levels.append(now)
        depth = 1 << len(levels)
        now = _shared(_extended(now, depth >> 1), ["rank", "next"], str(depth))
    return levels


def _deepened(state: DataFrame | None, level: DataFrame, step: int) -> DataFrame:
    """All states after trying ``step`` lines more.

    A state tells that the first ``depth`` lines at a place also begin at an earlier one, the earliest being ``first``, which also names these
    lines. Whoever holds ``step`` lines more of them for the first time is the place ``first`` itself or in this same state, so groups
    of equal states and their firsts find the next first places. A place whose longer run overlaps its first place goes on as two states.
    """
    nowhere = F.struct(F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("version"), F.lit(-1).alias("pos"))
    fresh = level.select(*PLACE, "rank")
    if state is None:
        rows = fresh.select(*PLACE, F.lit(0).alias("depth"), F.lit(BOTH).alias("kind"), nowhere.alias("first"), "rank")
    else:
        firsts = (state.filter("depth > 0").select("first", "depth").distinct()
                  .select("first.*", "depth", F.lit(FIRST).alias("kind"), "first"))
        further = level.select(*KEY, F.col("pos").alias("_at"), "rank")
        known = state.unionByName(firsts).withColumn("_at", F.col("pos") + F.col("depth")).join(further, [*KEY, "_at"], "left")
        rows = (known.select(*STATE, "rank")
                .unionByName(fresh.join(state.select(*PLACE), PLACE, "left_anti")
                             .select(*PLACE, F.lit(0).alias("depth"), F.lit(BOTH).alias("kind"), nowhere.alias("first"), "rank")))
    rows = stored(rows, f"tried-{step}")
    here = F.struct(*PLACE)
    # Stored, so that a hot group's rows meet it by a broadcast, or by a join whose large side can be split.
    least = stored(rows.filter("rank IS NOT NULL").groupBy("first", "depth", "rank").agg(F.min(here).alias("_least"), F.count(F.lit(1)).alias("_n"))
                   .filter("_n > 1").drop("_n"), f"firsts-{step}")
    tried = rows.filter(F.col("kind") != FIRST).join(least, ["first", "depth", "rank"], "left")
    deeper = F.col("depth") + step
    overlaps = (F.col("doc") == F.col("_least.doc")) & (F.col("version") == F.col("_least.version")) & (F.col("_least.pos") + deeper > F.col("pos"))

    def now(kind: Column | int) -> Column:
        return F.struct(F.col("depth"), (F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), F.col("first"))

    def then(kind: Column | int) -> Column:
        return F.struct(deeper.alias("depth"), (F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), F.col("_least").alias("first"))

    kind = F.col("kind")
    after = (F.when(F.col("_least").isNull() | (F.col("_least") >= here), F.array(now(kind)))
             .when(~overlaps | (kind == ANY), F.array(then(kind)))
             .when(kind == APART, F.array(now(kind)))
             .otherwise(F.array(then(ANY), now(APART))))
    moved = tried.select(*PLACE, F.explode(after).alias("s")).select(*PLACE, "s.depth", "s.kind", "s.first")
    return stored(moved.filter((F.col("depth") > 0) | (F.col("kind") == APART)), f"repeats-{step}")


def longest_repeats(levels: list[DataFrame]) -> DataFrame | None:
    """``(doc, version, pos, n_lines, first)``: at each place the longest run that begins there and at an earlier place; None without any.

    Earlier is a smaller document id, or the same document without overlap; ``first`` is the run's earliest place.
    """
    state = None
    for k in reversed(range(len(levels))):
        state = _deepened(state, levels[k], 1 << k)
    return None if state is None else state.filter((F.col("kind") != ANY) & (F.col("depth") > 0)).select(*PLACE, F.col("depth").alias("n_lines"), "first")


def _judged(documents: DataFrame, doc_id: str, text: str, min_lines: int, min_words: int) -> DataFrame | None:
    """All repeated lines with the longest earlier run at each: is it ``maximal``, does it ``go``, and up to where are lines ``cut``."""
    levels = suffix_levels(line_ids(documents, doc_id, text))
    longest = longest_repeats(levels)
    if longest is None:
        return None
    # A run's lines are all repeated ones, so they stand in consecutive rows; one document's lines are one group.
    order = Window.partitionBy(*KEY).orderBy("pos")
    table = levels[0].select(*PLACE, "line_no", "words").join(longest, PLACE, "left")
    end = F.col("pos") + F.col("n_lines")
    goes = F.col("n_lines") >= min_lines
    for n in range(1, min_lines):
        goes = goes | ((F.col("n_lines") == n) & (F.sum("words").over(order.rowsBetween(0, n - 1)) >= min_words))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"goes": F.coalesce(goes, F.lit(False)), "maximal": end > F.coalesce(F.max(end).over(before), F.lit(-1))})
    return table.withColumn("cut", F.max(F.when(F.col("goes"), end)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, version, pos, n_lines, first_doc, first_version, first_pos)``: the maximal runs that repeat an earlier run and are to go.

    A run is maximal if no longer one holds it; it goes if it has ``min_lines`` lines or ``min_words`` words. Earlier is a smaller document
    id, or the same document without overlap.
    """
    judged = _judged(documents, doc_id, text, min_lines, min_words)
    if judged is None:
        return documents.sparkSession.createDataFrame([], "doc long, version long, pos int, n_lines int, first_doc long, first_version long, first_pos int")
    return (judged.filter(F.col("maximal") & F.col("goes"))
            .select(*PLACE, "n_lines", F.col("first.doc").alias("first_doc"), F.col("first.version").alias("first_version"), F.col("first.pos").alias("first_pos")))


def removed_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, version, gone)``: per document the stretches of line numbers, counted from 0, that repeat an earlier run."""
    judged = _judged(documents, doc_id, text, min_lines, min_words)
    if judged is None:
        return documents.sparkSession.createDataFrame([], "doc long, version long, gone array<struct<`from`: int, `to`: int>>")
    island = (F.col("line_no") - F.row_number().over(Window.partitionBy(*KEY).orderBy("line_no"))).alias("island")
    lines = judged.filter(F.col("cut") > F.col("pos")).select(*KEY, "line_no", island)
    stretches = lines.groupBy(*KEY, "island").agg(F.min("line_no").alias("from"), F.max("line_no").alias("to"))
    return stretches.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("gone"))


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES,
                    min_words: int = MIN_WORDS) -> DataFrame:
    """All documents, with repeated line runs cut from the text, and ``n_lines``, ``n_removed``.

    A run goes if it has ``min_lines`` lines or ``min_words`` words (separated by ASCII white space) and occurs at an earlier place.
    ``n_lines`` counts lines with more than white space. Blank lines belong to no run and stay. NULL texts stay
    NULL with no lines. A row without id counts as the last document. Rows that are equal in id and
    text get the same answer; rows with the same id and other texts are ordered by a hash of the text.
    Own columns named like the added ones are replaced.
    """
    documents, back = set_aside(documents, ["_doc", "_version", "gone"])
    names = {old: new for new, old in back.items()}
    doc_id, text = names.get(doc_id, doc_id), names.get(text, text)
    gone = stored(removed_lines(documents, doc_id, text, min_lines, min_words), "gone").withColumnsRenamed({"doc": "_doc", "version": "_version"})
    kept = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    body = F.col(f"`{text}`")
    # Texts meet their cuts by a sort-merge join at every size; a broadcast of the cuts would grow with the repeats.
    table = _identified(documents.select(*[F.col(f"`{c}`") for c in kept]), doc_id, text).join(gone.hint("merge"), ["_doc", "_version"], "left")
    rest = F.filter(F.split(body, "\n"), lambda line, i: ~F.exists("gone", lambda g: (i >= g["from"]) & (i <= g["to"])))
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda s, g: s + g["to"] - g["from"] + 1), F.lit(0).cast("long"))
    lines = F.when(body.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S")))).cast("long")
    cut = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(rest, "\n"))
    return (table.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in kept], lines.alias("n_lines"), removed.alias("n_removed"))
            .withColumnsRenamed(back))
