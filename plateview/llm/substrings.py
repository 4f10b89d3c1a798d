"""Exact removal of repeated byte strings, by hash-compared suffix sorting of sampled suffixes.

A byte goes if a string of ``LEAST`` bytes that covers it also starts in a document of smaller id. Prefix
polynomial hashes give the hash of any stretch of a text at once. Every window of ``LEAST`` bytes is filed under
the smallest hash among the grams in it, a function of its content, so equal windows meet under one gram; neighbouring
windows under the same gram form a run, and the bytes of a run are its context.

1. Runs are grouped by gram. A context that an earlier document has, too, is covered whole; most repeats end here.
2. Grams with several contexts send each context from its first document. There the windows are suffixes: those whose hash
   occurs again are ordered by their first bytes and then by a merge sort, two being compared by binary search for their
   common extension over prefix hashes; neighbours that agree on ``LEAST`` bytes are verified byte by byte.
3. Each document marks what both steps cover, and keeps the rest.

Texts are shuffled once, into batches of bounded size; all three steps read that shuffle. Within a batch equal contexts
are one record, so a passage in a third of all documents sends one record per batch. Grams that are frequent in a
bounded sample are passed over wherever a window holds a rarer one, which spreads the borders of such passages; the
choice moves load only, results are the same for any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plateview.llm.buffers import U64, byte_column, chunks, mix, odd_powers

LEAST = 50
GRAM = 20
BATCH_BYTES = 4 << 20        # text of a batch
PART_BYTES = 8 << 20         # text whose runs meet in a task, about
CHUNK_BYTES = 1 << 18        # text that is hashed at once
SAMPLE_ROWS = 20_000         # documents in which frequent grams are looked for, at most
FREQUENT = 0.002             # share of the sample that makes a gram frequent
_BASE = 0x9E3779B97F4A7C15
KEPT_BITS = U64((1 << 56) - 1)      # of a gram's hash; contexts of a gram are told apart by 64 bits of their own
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + LEAST + 2)
        _powers[:] = [odd_powers(_BASE, size), odd_powers(pow(_BASE, -1, 1 << 64), size)]
    return _powers[0], _powers[1]


class Hashes:
    """Prefix polynomial hashes of a stretch of bytes, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data) + 1)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], dtype=U64, out=self.prefix[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of the stretches; equal stretches have equal hashes wherever they stand."""
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def grams(self) -> np.ndarray:
        raw = (self.prefix[GRAM:] - self.prefix[:-GRAM]) * self.inverse[: len(self.prefix) - GRAM]
        return mix(raw) >> U64(1)

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension at ``a`` and ``b``, up to ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    out, w = values, 1
    while w * 2 <= width:
        out, w = np.minimum(out[:-w], out[w:]), w * 2
    return np.minimum(out[: len(out) - (width - w)], out[width - w:]) if width > w else out


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first document, offset of the bytes, bounds)``: documents in groups, long ones in stretches that share all but one byte of a window."""
    for low, high in chunks(ends, CHUNK_BYTES):
        start, stop = int(ends[low]), int(ends[high])
        if stop - start <= 2 * CHUNK_BYTES:
            yield low, start, ends[low: high + 1] - start
        else:
            for a in range(start, max(stop - LEAST + 1, start + 1), CHUNK_BYTES):
                yield low, a, np.array([0, min(a + CHUNK_BYTES + LEAST - 1, stop) - a])


class Runs:
    """Runs of neighbouring windows under one gram: first and last window, gram, hash of the context, document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, frequent: np.ndarray):
        self.hashes = Hashes(data)
        windows = len(data) - LEAST + 1
        if windows <= 0:
            self.low = self.high = self.doc = np.zeros(0, np.int64)
            self.gram = self.context = np.zeros(0, U64)
            return
        grams = self.hashes.grams()
        # A hash of mixed grams instead of bytes: another function than the one that chose the gram.
        above = np.zeros(len(grams) + 1, U64)
        np.cumsum(mix(grams) * _power_tables(len(data) + 1)[0][: len(grams)], dtype=U64, out=above[1:])
        if len(frequent):
            hint = np.zeros(1 << 16, bool)
            hint[(frequent & U64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(hint[(grams & U64(0xFFFF)).astype(np.int64)])
            low = grams[maybe] & KEPT_BITS
            at = np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)
            grams[maybe[frequent[at] == low]] |= U64(1 << 63)
        least = _least_of(grams, LEAST - GRAM + 1)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = doc[:windows] == doc[LEAST - 1:]
        new = np.ones(windows, bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:windows] != doc[: windows - 1])
        last = np.ones(windows, bool)
        last[:-1] = new[1:] | ~inside[1:]
        self.low, self.high = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
        self.gram, self.doc = least[self.low] & KEPT_BITS, doc[self.low]
        size = self.high - self.low + LEAST
        whole = (above[self.high + LEAST - GRAM + 1] - above[self.low]) * self.hashes.inverse[self.low]
        self.context = mix(whole + size.astype(U64) * U64(0xD6E8FEB86659FD93))


# Columns of a message by type and bytes of a value; planes of equal bytes lie together, so that high bytes of small numbers compress away.
GRAMS, HASHES, NUMBERS, FLAGS = (U64, 7), (U64, 8), (np.int64, 8), (bool, 1)


def _pack(columns: list[np.ndarray], kinds: list[tuple]) -> bytes:
    return b"".join(np.ascontiguousarray(c).astype(t, copy=False).view(np.uint8).reshape(len(c), np.dtype(t).itemsize)[:, :k].T.tobytes() for c, (t, k) in zip(columns, kinds))


def _unpack(blob: bytes, kinds: list[tuple]) -> list[np.ndarray]:
    n, at, out = len(blob) // sum(k for _, k in kinds), 0, []
    for t, k in kinds:
        whole = np.zeros((n, np.dtype(t).itemsize), np.uint8)
        whole[:, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T
        out.append(whole.view(t).ravel())
        at += n * k
    return out


def _together(blobs: list[bytes], kinds: list[tuple]) -> list[np.ndarray]:
    parts = [_unpack(b, kinds) for b in blobs] or [_unpack(b"", kinds)]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


_SENT = "part long, batch long, kind int, blob binary"
_SENT_SCHEMA = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
RUNS, VERDICT, CONTEXTS, SPANS = 0, 1, 2, 3
_RUN, _FOUND = [GRAMS, HASHES, NUMBERS, FLAGS], [GRAMS, HASHES, NUMBERS, FLAGS]
_CONTEXT, _SPAN = [GRAMS, NUMBERS, NUMBERS, NUMBERS], [NUMBERS, NUMBERS]


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _SENT_SCHEMA.types)], schema=_SENT_SCHEMA) if rows else _SENT_SCHEMA.empty_table()


def _batch(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Bytes, bounds and ids of a batch's texts, in an order that does not depend on how the rows arrived."""
    table = table.take(pa.array(np.lexsort((np.array(table.column("_v")), np.array(table.column("_id"))))))
    data, ends = byte_column(table.column("text").combine_chunks())
    return data, ends, np.array(table.column("_id")), table


def _by_part(batch: int, gram: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows that go to each part."""
    part = (mix(gram) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        yield int(part[own[0]]), own


def _send_runs(table: pa.Table, frequent: np.ndarray, parts: int) -> pa.Table:
    """A batch's distinct contexts, with the first document that has each and whether another has it, too."""
    data, ends, ids, _ = _batch(table)
    gram, context, doc = [], [], []
    for first, offset, bounds in _pieces(ends):
        runs = Runs(data[offset: offset + bounds[-1]], bounds, frequent)
        gram.append(runs.gram)
        context.append(runs.context)
        doc.append(ids[first + runs.doc])
    gram, context, doc = map(np.concatenate, (gram, context, doc))
    if not len(gram):
        return _sent([])
    order = np.lexsort((doc, context, gram))
    gram, context, doc = gram[order], context[order], doc[order]
    at = np.flatnonzero(_edges(gram, context))
    several = doc[np.append(at[1:], len(doc)) - 1] != doc[at]
    columns = [gram[at], context[at], doc[at], several]
    batch = table.column("batch")[0].as_py()
    return _sent([(part, batch, RUNS, _pack([c[own] for c in columns], _RUN)) for part, own in _by_part(batch, gram[at], parts)])


def _by_source(source: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(source, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(source[order])) + 1) if len(order) else ()


def _judge_runs(table: pa.Table) -> pa.Table:
    """For every context that an earlier document or another context of its gram touches: its first document, and whether to compare."""
    batches = table.column("batch").to_pylist()
    columns = [_unpack(blob, _RUN) for blob in table.column("blob").to_pylist()]
    source = np.repeat(np.arange(len(batches)), [len(c[0]) for c in columns])
    gram, context, doc, several = (np.concatenate([c[i] for c in columns]) for i in range(4))
    order = np.lexsort((doc, context, gram))
    gram, context, doc, several, source = (x[order] for x in (gram, context, doc, several, source))
    new_gram, new = _edges(gram), _edges(gram, context)
    at = np.flatnonzero(new)
    first = doc[at]
    group = np.cumsum(new_gram)[at] - 1
    starts = np.flatnonzero(_edges(group))
    compare = (np.minimum.reduceat(first, starts) != np.maximum.reduceat(first, starts))[group]
    which = np.cumsum(new) - 1
    first, compare = first[which], compare[which]
    useful = np.flatnonzero((first < doc) | several | (compare & (first == doc)))
    found = [c[useful] for c in (gram, context, first, compare)]
    return _sent([(0, batches[source[useful[own[0]]]], VERDICT, _pack([c[own] for c in found], _FOUND)) for own in _by_source(source[useful])])


class Verdicts:
    """What step 1 found for the contexts of a batch."""

    def __init__(self, blobs: list[bytes]):
        gram, context, first, compare = _together(blobs, _FOUND)
        order = np.argsort(self._key(gram, context))
        self.gram, self.context, self.first, self.compare = gram[order], context[order], first[order], compare[order]
        self.key = self._key(self.gram, self.context)

    @staticmethod
    def _key(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
        return mix(gram + context * U64(0xA24BAED4963EE407))

    def find(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Runs that have a verdict, and where it is."""
        if not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, self._key(runs.gram, runs.context)), len(self.key) - 1)
        known = np.flatnonzero((self.gram[at] == runs.gram) & (self.context[at] == runs.context))
        return known, at[known]


def _covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a span."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(change[:-1]) > 0


def _spans(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _send_contexts(table: pa.Table, verdicts: pa.Table, frequent: np.ndarray, parts: int) -> pa.Table:
    """What whole contexts cover, for the batch itself, and the contexts to compare, each from its first document with its place."""
    if not len(table):
        return _sent([])
    data, ends, ids, _ = _batch(table)
    batch, held = table.column("batch")[0].as_py(), Verdicts(verdicts.column("blob").to_pylist())
    low, high, gram, doc, size, place, body = [], [], [], [], [], [], []
    for first, offset, bounds in _pieces(ends):
        runs = Runs(data[offset: offset + bounds[-1]], bounds, frequent)
        known, at = held.find(runs)
        own = ids[first + runs.doc[known]]
        whole = held.first[at] < own
        low.append(runs.low[known[whole]] + offset)
        high.append(runs.high[known[whole]] + offset + LEAST)
        wanted = held.compare[at] & (held.first[at] == own)
        known = known[wanted]
        gram.append(runs.gram[known])
        doc.append(own[wanted])
        size.append(runs.high[known] - runs.low[known] + LEAST)
        place.append(runs.low[known] + offset)
        body += [data[a: a + n].tobytes() for a, n in zip(place[-1].tolist(), size[-1].tolist())]
    rows = [(-1 - batch, batch, SPANS, _pack(list(_spans(_covered(np.concatenate(low), np.concatenate(high), len(data)))), _SPAN))]
    columns = [np.concatenate(x) for x in (gram, doc, size, place)]
    for part, own in _by_part(batch, columns[0], parts):
        head = _pack([c[own] for c in columns], _CONTEXT)
        rows.append((part, batch, CONTEXTS, len(own).to_bytes(8, "little") + head + b"".join(body[i] for i in own)))
    return _sent(rows)


def merge_sorted(hashes: Hashes, items: np.ndarray, groups: np.ndarray, at: np.ndarray, depth: int = LEAST) -> np.ndarray:
    """``items`` ordered within each group (consecutive equal numbers) by the ``depth`` bytes that follow ``at[item]``.

    Bottom-up merge sort of all groups at once: an element's place in a merged pair of runs is its place in its own run
    and the number of elements of the other run before it, found by binary search. Two suffixes whose hashes differ are
    compared at the byte after their common extension. Ties keep their order.
    """
    items = items.copy()
    n = len(items)
    start = np.flatnonzero(_edges(groups)) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    base, total = np.repeat(start, size), np.repeat(size, size)
    inside = np.arange(n) - base

    whole = hashes.of(at, depth)

    def before(a, b, or_equal):
        """Whether the suffix of item a stands before that of item b."""
        out = or_equal.copy()
        i = np.flatnonzero(whole[a] != whole[b])
        x, y = at[a[i]], at[b[i]]
        step = np.minimum(hashes.common(x, y, depth), depth - 1)
        out[i] = hashes.data[x + step] < hashes.data[y + step]
        return out

    width = 1
    while n and width < size.max():
        active = np.flatnonzero(total > width)
        own = inside[active]
        pair = own // (2 * width) * (2 * width)
        left = own - pair < width
        low = base[active] + np.where(left, np.minimum(pair + width, total[active]), pair)
        high = base[active] + np.where(left, np.minimum(pair + 2 * width, total[active]), np.minimum(pair + width, total[active]))
        other, me, a, b = low.copy(), items[active], low, high
        while (open_ := a < b).any():
            i = np.flatnonzero(open_)
            middle = (a[i] + b[i]) // 2
            # From the left run count smaller ones on the right; from the right run also equal ones on the left.
            right = before(items[middle], me[i], ~left[i])
            a[i], b[i] = np.where(right, middle + 1, a[i]), np.where(right, b[i], middle)
        target = base[active] + pair + np.where(left, own - pair, own - pair - width) + (a - other)
        merged = items.copy()
        merged[target] = me
        items, width = merged, 2 * width
    return items


def _prefixes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first eight bytes at each place as a number of the same order."""
    out = np.zeros(len(places), U64)
    for i in range(8):
        out = out << U64(8) | data[places + i].astype(U64)
    return out


def _judge_contexts(table: pa.Table) -> pa.Table:
    """The windows of each context that an earlier document's context of the same gram holds, too, as spans of their batch."""
    kinds, batches, blobs = (table.column(c).to_pylist() for c in ("kind", "batch", "blob"))
    rows = [(0, batch, kind, blob) for kind, batch, blob in zip(kinds, batches, blobs) if kind == SPANS]
    heads, bodies, source, width = [], [], [], sum(k for _, k in _CONTEXT)
    for i, (kind, blob) in enumerate(zip(kinds, blobs)):
        if kind == CONTEXTS:
            n = int.from_bytes(blob[:8], "little")
            heads.append(_unpack(blob[8: 8 + width * n], _CONTEXT))
            bodies.append(np.frombuffer(blob, np.uint8, offset=8 + width * n))
            source.append(np.full(n, i))
    if not heads:
        return _sent(rows)
    gram, doc, size, origin = (np.concatenate([h[i] for h in heads]) for i in range(4))
    data, source = np.concatenate(bodies), np.concatenate(source)
    hashes = Hashes(data)
    start = np.cumsum(size) - size
    count = size - LEAST + 1
    owner = np.repeat(np.arange(len(size)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = start[owner] + window
    # A window whose hash is alone here has no equal; the others are sorted.
    _, which, times = np.unique(hashes.of(place, LEAST), return_inverse=True, return_counts=True)
    keep = times[which] > 1
    owner, window, place = owner[keep], window[keep], place[keep]
    if not len(place):
        return _sent(rows)
    # Where in the window its gram first stands: equal windows agree in that.
    held = np.repeat(np.arange(len(size)), size)[: len(data) - GRAM + 1]
    occurs = np.flatnonzero(hashes.grams() & KEPT_BITS == gram[held])
    offset = occurs[np.minimum(np.searchsorted(occurs, place), len(occurs) - 1)] - place
    lead = _prefixes(data, place)
    order = np.lexsort((doc[owner], lead, offset, gram[owner]))
    group = np.cumsum(_edges(gram[owner][order], offset[order], lead[order])) - 1
    owner, window, place = owner[order], window[order], place[order]
    ranked = merge_sorted(hashes, np.arange(len(place)), group, place)
    owner, window, placed = owner[ranked], window[ranked], place[ranked]
    # Neighbours that agree by hash are verified by their bytes.
    alike = np.flatnonzero((group[1:] == group[:-1]) & (hashes.of(placed[1:], LEAST) == hashes.of(placed[:-1], LEAST)))
    same = np.zeros(len(placed), bool)
    for low in range(0, len(alike), 1 << 16):
        i = alike[low: low + (1 << 16)]
        span = np.arange(LEAST)
        same[i + 1] = (data[placed[i + 1][:, None] + span] == data[placed[i][:, None] + span]).all(axis=1)
    block = np.flatnonzero(~same)
    first = np.minimum.reduceat(doc[owner], block)[np.cumsum(~same) - 1]
    gone = np.flatnonzero(first < doc[owner])
    spot = origin[owner[gone]] + window[gone]
    for own in _by_source(source[owner[gone]]):
        at = np.unique(spot[own])
        new = np.concatenate([[True], np.diff(at) > 1])
        last = np.concatenate([at[:-1][new[1:]], at[-1:]])
        rows.append((0, batches[source[owner[gone[own[0]]]]], SPANS, _pack([at[new], last + LEAST], _SPAN)))
    return _sent(rows)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(table: pa.Table, spans: pa.Table) -> pa.Table:
    """Every document without what the spans cover."""
    if not len(table):
        return _KEPT.empty_table()
    data, ends, _, table = _batch(table)
    gone = _covered(*_together(spans.column("blob").to_pylist(), _SPAN), len(data))
    removed, kept = [], []
    for a, b in zip(ends[:-1], ends[1:]):
        own = gone[a:b]
        if own.any():
            removed.append([{"start": int(x), "end": int(y)} for x, y in zip(*_spans(own))])
            kept.append(data[a:b][~own].tobytes())
        else:
            removed.append([])
            kept.append(data[a:b].tobytes())
    ids = table.column("doc_id").combine_chunks()
    return pa.table([ids, pa.array(np.diff(ends)), pa.array(removed, _KEPT.field("spans").type), pa.array(kept, pa.binary())], schema=_KEPT)


def frequent_grams(documents: DataFrame, rows: int = SAMPLE_ROWS, share: float = FREQUENT) -> np.ndarray:
    """Grams under which windows of more than ``share`` of at most ``rows`` sampled texts are filed; at most 1/share times the grams of a text."""
    n = max(documents.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit(31), "text"), F.lit(1 << 40))
    some = documents.select("text").filter(draw < int(min(1.0, rows / n) * (1 << 40))).limit(rows)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = byte_column(batch.column(0))
            for _, offset, bounds in _pieces(ends):
                runs = Runs(data[offset: offset + bounds[-1]], bounds, np.zeros(0, U64))
                order = np.lexsort((runs.doc, runs.gram))
                order = order[_edges(runs.gram[order], runs.doc[order])] if len(order) else order
                gram, count = np.unique(runs.gram[order], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(count)], names=["gram", "n"])

    limit = max(8, int(min(n, rows) * share))
    found = some.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).select("gram").collect()
    return np.sort(np.array([r.gram for r in found], np.int64).view(U64))


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: the removed byte ranges of every document, and the bytes that stay.

    Texts are UTF-8 bytes, NULL is empty; cuts may fall inside a character. All is judged on the input. Repeats inside
    one document stay, and so do those among rows that share a doc_id: neither is smaller. A row without an
    id counts as the largest. Texts below ``LEAST`` bytes lose nothing. Other columns are left out; no rows give no rows.
    """
    base = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, batches = total // PART_BYTES + 1, total // BATCH_BYTES + 1
    frequent = frequent_grams(base)
    keyed = base.withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn(
        "batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).withColumn("_v", F.xxhash64("text")).select("batch", "doc_id", "_id", "_v", "text")
    runs = keyed.groupBy("batch").applyInArrow(lambda t: _send_runs(t, frequent, parts), _SENT)
    verdicts = runs.groupBy("part").applyInArrow(_judge_runs, _SENT)
    contexts = keyed.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(lambda t, v: _send_contexts(t, v, frequent, parts), _SENT)
    judged = contexts.groupBy("part").applyInArrow(_judge_contexts, _SENT)
    return keyed.groupBy("batch").cogroup(judged.groupBy("batch")).applyInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
