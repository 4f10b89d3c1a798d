"""Benchmark passages in training documents, found by suffix arrays over the documents' words.

Words of a document that no benchmark item uses end every possible match, so a shard's suffix
array covers the runs of benchmark words that are long enough to hold a window. Every benchmark
suffix is searched in it by binary search, one word deeper at a time, which gives the longest
verbatim match and all its places. The benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plateview.llm.buffers import ALNUM, Words, byte_column, chunks
from plateview.llm.columns import set_aside
from plateview.sources.scratch import stored

WINDOW = 10                 # words of a window; an item of fewer words is one window
SHARD_BYTES = 1 << 20       # text whose words share a suffix array
BLOCK_BYTES = 32 << 20      # benchmark text that a task holds at once


class Benchmark:
    """Items as sequences of word numbers, with every suffix that can begin a match."""

    def __init__(self, ids: list, texts: list, window: int):
        data, ends = byte_column(pa.array(texts, pa.large_string()))
        words = Words(data, ends, ALNUM)
        self.window = window
        self.vocabulary, numbers = np.unique(words.hash, return_inverse=True)
        self.words = numbers.astype(np.int64) + 1
        self.bounds = words.bounds
        self.names = [str(i) for i in ids]
        sizes = np.diff(self.bounds)
        need = np.minimum(sizes, window)
        self.shortest = int(need[sizes > 0].min()) if (sizes > 0).any() else 0
        self.deepest = int(sizes.max()) if len(sizes) else 0
        # A suffix is searched if it has room for a whole window of its item.
        item = np.repeat(np.arange(len(sizes)), sizes)
        left = self.bounds[1:][item] - np.arange(len(item))
        fits = left >= need[item]
        self.suffix, self.left, self.need, self.item = np.flatnonzero(fits), left[fits], need[item][fits], item[fits]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``words`` ordered by what follows them, compared over at least ``depth`` words (prefix doubling)."""
    rank, order, known = words.astype(np.int64), np.argsort(words, kind="stable"), 1
    while known < depth:
        after = np.zeros_like(rank)
        after[:-known or None] = rank[known:] if known < len(rank) else 0
        key = rank * (rank.max() + 1 if len(rank) else 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) + 1
        rank = np.empty_like(rank)
        rank[order] = steps
        known *= 2
        if len(steps) and steps[-1] == len(steps):
            break
    return order


def search(words: np.ndarray, order: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every searched suffix: the places in ``order`` that share a whole window, the length of its
    longest match, and a place of that match.

    All suffixes advance together: in the interval of places that share t words, binary search finds
    those whose next word is the suffix's next word.
    """
    n, q = len(order), len(bench.suffix)
    padded = np.concatenate([words, [0]])
    low, high = np.zeros(q, np.int64), np.full(q, n, np.int64)
    window_low, window_high, longest, place = np.zeros(q, np.int64), np.zeros(q, np.int64), np.zeros(q, np.int64), np.zeros(q, np.int64)
    alive, depth = np.arange(q), 0
    while len(alive):
        alive = alive[bench.left[alive] > depth]
        target = bench.words[bench.suffix[alive] + depth]
        edges = []
        for strict in (False, True):
            a, b = low[alive].copy(), high[alive].copy()
            while (open_ := a < b).any():
                middle = (a + b) // 2
                word = padded[np.minimum(order[np.minimum(middle, n - 1)] + depth, n)]
                right = ((word <= target) if strict else (word < target)) & open_
                a, b = np.where(right, middle + 1, a), np.where(open_ & ~right, middle, b)
            edges.append(a)
        low[alive], high[alive] = edges
        depth += 1
        alive = alive[edges[0] < edges[1]]
        longest[alive], place[alive] = depth, order[low[alive]]
        whole = alive[bench.need[alive] == depth]
        window_low[whole], window_high[whole] = low[whole], high[whole]
    return window_low, window_high, longest, place


def _shard(words: Words, low: int, bench: Benchmark) -> Iterator[tuple]:
    """``(row, first word, words, item, longest, in_item)`` of every window found; rows count from ``low``."""
    if not bench.shortest or not len(words.hash):
        return
    at = np.minimum(np.searchsorted(bench.vocabulary, words.hash), len(bench.vocabulary) - 1)
    number = np.where(bench.vocabulary[at] == words.hash, at + 1, 0).astype(np.int64)
    known = number > 0
    edge = np.concatenate([[True], words.text[1:] != words.text[:-1]]) | ~known | np.concatenate([[True], ~known[:-1]])
    run = np.cumsum(edge) - 1
    keep = known & (np.bincount(run)[run] >= bench.shortest)
    places = np.flatnonzero(keep)
    if not len(places):
        return
    # Runs side by side, each closed by a 0 that no suffix matches.
    gap = np.concatenate([[0], np.cumsum(run[places][1:] != run[places][:-1])])
    sequence = np.zeros(len(places) + gap[-1] + 1, np.int64)
    sequence[np.arange(len(places)) + gap] = number[places]
    source = np.zeros(len(sequence), np.int64)
    source[np.arange(len(places)) + gap] = places
    order = suffix_array(sequence, bench.deepest)
    first, last, longest, _ = search(sequence, order, bench)
    found = np.flatnonzero(last > first)
    size = (last - first)[found]
    if not len(found):
        return
    which = np.repeat(found, size)
    spot = source[order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[found], size)]]
    yield words.text[spot] + low, spot - words.bounds[words.text[spot]], bench.need[which], bench.item[which], longest[which]


def _merged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same words."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate((start + size)[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]]) - start[new]


FOUND = "n_words long, n_hit long, n_items long, items array<string>, longest long, spans array<struct<first:long,words:long>>"
NAMES = ["n_words", "n_hit", "n_items", "items", "longest", "spans"]


def _scan(documents: DataFrame, bench: Benchmark, text: str, keep: list[str], again: bool) -> DataFrame:
    """One block of the benchmark against all documents; ``again``: add to what earlier blocks found."""
    wanted = list(dict.fromkeys([*keep, text, *(NAMES if again else [])]))
    table = documents.select(*[F.col(f"`{c}`") for c in wanted])
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep), FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            data, ends = byte_column(column[text])
            n = batch.num_rows
            counts, hit, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
            if again:
                items, spans = column["items"].to_pylist(), column["spans"].to_pylist()
                hit, longest = np.array(column["n_hit"]), np.array(column["longest"])
            for low, high in chunks(ends, SHARD_BYTES):
                words = Words(data[ends[low]: ends[high]], ends[low: high + 1] - ends[low], ALNUM)
                counts[low:high] = np.diff(words.bounds)
                for row, first, size, item, long in _shard(words, low, bench):
                    order = np.argsort(row, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
                        r = int(row[own[0]])
                        starts = np.concatenate([first[own], np.array([s["first"] for s in spans[r]], np.int64)])
                        sizes = np.concatenate([size[own], np.array([s["words"] for s in spans[r]], np.int64)])
                        a, b = _merged(starts, sizes)
                        hit[r], longest[r] = b.sum(), max(longest[r], long[own].max())
                        items[r] = sorted({*items[r], *(bench.names[i] for i in np.unique(item[own]))})
                        spans[r] = [{"first": int(x), "words": int(y)} for x, y in zip(a, b)]
            found = [pa.array(counts), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())),
                     pa.array(longest), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in keep), *found], names=[*keep, *NAMES])

    return table.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[tuple[list, list, bool]]:
    """Ids and texts of about ``most`` characters, and whether they are the last."""
    ids, texts, size = [], [], 0
    for name, body in benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).toLocalIterator():
        if size >= most:
            yield ids, texts, False
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(body)
        size += len(body or "")
    yield ids, texts, True


def matches(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text",
            item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of every document, and what it shares with the benchmark.

    ``n_words``; ``n_hit``: words inside an occurrence of a window of an item; ``items``: the ids found, as
    text in code-point order, ``n_items`` of them; ``longest``: words of the longest verbatim match;
    ``spans``: disjoint (first word, words) pairs of what was hit. Own columns of these names are replaced.

    The benchmark passes through the driver in blocks of ``block_bytes``, each a scan of the documents without
    a shuffle; one block is the usual case, and what several find is merged. NULL or empty texts and
    items have no words; repeated rows are treated alike; an item id that occurs twice counts once.
    """
    keep = [c for c in (keep if keep is not None else documents.columns) if c not in NAMES]
    result, carried = None, keep
    for number, (ids, texts, last) in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        # Only if there is another block does the text travel on.
        carried = keep if last else list(dict.fromkeys([*keep, text]))
        source = documents if number == 0 else stored(result, "decontaminate")
        result = _scan(source, Benchmark(ids, texts, window), text, carried, number > 0)
    return result.select(*[F.col(f"`{c}`") for c in [*keep, *NAMES]])


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their own columns, that share no window with the benchmark."""
    plain, back = set_aside(documents, [n for n in NAMES if n != text])
    return matches(plain, benchmark, None, text, window=window).filter(F.col("n_hit") == 0).select(
        *[F.col(f"`{c}`") for c in plain.columns]).withColumnsRenamed(back)
