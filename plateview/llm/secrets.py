"""Secrets in texts: fixed patterns, and spans that a linear-chain conditional random field adds.

The field tags tokens as begin, inside or outside of a secret from their shape, neighbouring words and
features of the whole text. It is trained here, on a bounded sample whose labels are the pattern matches, and
decoded by Viterbi. Tokens so clearly outside that no choice of neighbours can change it split a text
into short stretches, and only these are decoded; the result is that of the whole sequence.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plateview.llm.buffers import U64, mix, odd_powers

# The patterns that define the base spans, in the order of kinds.
KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")      # runs are maximal, so shorter ones need no match
LEAST_VALUE, LEAST_ACCESS = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# What a text with a base span holds, in the syntax of column functions: the same three patterns with their least lengths.
HOLDS_SECRET = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""

FIT_ROWS = 6_000             # documents of the training sample, at most
FIT_WINDOWS = 6_000          # token windows learned from, at most
WINDOW = 8                   # tokens on either side of a window's centre
CHUNK_CHARS = 1 << 20
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the secret itself)`` of all pattern matches, in code points, in order."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS) or not low.isascii():
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


# --- tokens and their features ---------------------------------------------------------------

# Character classes: 0 no token, 1 lower, 2 upper, 3 digit, 4 one of _ + / -, 5 outside ASCII.
_CLASS = np.zeros(129, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128] = 1, 2, 3, 5
_CLASS[[ord(c) for c in "_+/-"]] = 4
_LENGTHS = np.array([2, 3, 4, 5, 7, 9, 12, 16, 24, 40, 64])
_HASHED = 1 << 10
# Feature tables one after another: shape x length, digits x changes, hex x length, both gaps, previous, one before, next, prefix, file.
_SIZES = [64 * 12, 30, 2 * 12, 8, 8, _HASHED, _HASHED, _HASHED, _HASHED, 25]
_OFFSETS = np.cumsum([0, *_SIZES])
FEATURES = int(_OFFSETS[-1])


class Tokens:
    """Tokens of several texts, their places in code points, and a row of feature numbers for each."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(sizes + 1) - sizes - 1
        kind = _CLASS[np.minimum(points, 128)]
        inside = np.concatenate([[False], kind > 0, [False]])
        self.start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        self.end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        self.bounds = np.searchsorted(self.start, np.append(self.base, len(points) + 1))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.features = self._features(points, kind, sizes) if len(self.start) else np.zeros((0, len(_SIZES)), np.int64)

    def _features(self, points, kind, sizes):
        a, b = self.start, self.end
        n, size = len(a), b - a

        def within(flags, low, high):
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
            return total[high] - total[low]

        count = [within(kind == k, a, b) for k in range(1, 6)]
        shape = sum((c > 0).astype(np.int64) << i for i, c in enumerate(count)) + 32 * (count[1] == size)
        length = np.searchsorted(_LENGTHS, size, side="right")
        changes = within(np.concatenate([[False], kind[1:] != kind[:-1]]), a + 1, b)
        digits = np.minimum(count[2] * 4 // size, 4) + (count[2] > 0) * (count[2] * 4 < size)
        hexes = within(((points >= 48) & (points < 58)) | ((points >= 97) & (points < 103)), a, b) == size
        gap_low, gap_high = np.concatenate([[0], b]), np.concatenate([a, [len(points)]])
        gap = np.where(gap_high - gap_low == 1, 1, 2) + 0
        gap = np.where(within((points == 34) | (points == 39), gap_low, gap_high) > 0, 3, gap)
        gap = np.where(within((points == 61) | (points == 58), gap_low, gap_high) > 0, gap + 3, gap)
        gap = np.where(within(points == 10, gap_low, gap_high) > 0, 7, gap)
        gap[0] = gap[-1] = 0
        first, last = self.bounds[:-1][np.diff(self.bounds) > 0], self.bounds[1:][np.diff(self.bounds) > 0] - 1
        before, after = gap[:-1].copy(), gap[1:].copy()
        before[first] = after[last] = 0
        # Lower-case words as hashes; what lies outside the text has number 0.
        letters = points[kind > 0].astype(U64)
        letters += U64(32) * ((letters >= U64(65)) & (letters < U64(91)))
        where = np.cumsum(size) - size
        place = np.minimum(np.arange(len(letters)) - np.repeat(where, size), 63)
        word = mix(np.add.reduceat(letters * odd_powers(0x9E3779B97F4A7C15, 64)[place], where)) % U64(_HASHED - 1) + U64(1)
        prefix = np.zeros(n, U64)
        for i in range(4):
            prefix = prefix * U64(0x1F3D5B79) + np.where(size > i, points[np.minimum(a + i, len(points) - 1)], 0).astype(U64)

        def shifted(by):
            out = np.zeros(n, np.int64)
            if n > abs(by):
                source, target = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
                out[target] = np.where(self.text[source] == self.text[target], word[source].astype(np.int64), 0)
            return out

        # The file: how much of it is digits, and how many tokens mix digits with letters.
        share = np.add.reduceat(np.concatenate([kind == 3, [False]]).astype(np.int64), np.minimum(self.base, len(kind))) / np.maximum(sizes, 1)
        mixed = np.bincount(self.text, (count[2] > 0) & (count[0] + count[1] > 0), len(sizes)) / np.maximum(np.diff(self.bounds), 1)
        file = np.searchsorted([0.001, 0.01, 0.05, 0.2], share) * 5 + np.searchsorted([0.001, 0.01, 0.05, 0.2], mixed)
        parts = [shape * 12 + length, digits * 6 + np.minimum(changes, 5), hexes * 12 + length, before, after,
                 shifted(1), shifted(2), shifted(-1), (mix(prefix) % U64(_HASHED)).astype(np.int64), file[self.text]]
        return np.stack(parts, axis=1) + _OFFSETS[:-1]

    def labels(self, spans: list[list[tuple]]) -> np.ndarray:
        """Tags of the tokens under the secrets of each text's ``base_spans``."""
        tags = np.zeros(len(self.start), np.int64)
        for t, own in enumerate(spans):
            for _, _, end, secret in own:
                low, high = self.bounds[t], self.bounds[t + 1]
                i = low + np.searchsorted(self.end[low:high], self.base[t] + secret, side="right")
                j = low + np.searchsorted(self.start[low:high], self.base[t] + end, side="left")
                tags[i:j] = INSIDE
                if j > i:
                    tags[i] = BEGIN
        return tags


# --- the field -------------------------------------------------------------------------------

@dataclass
class Field:
    weights: np.ndarray          # features x tags
    moves: np.ndarray            # tag x next tag

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def decode(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The likeliest tags of all texts at once."""
        n = len(scores)
        tags = np.zeros(n, np.int64)
        if not n:
            return tags
        reach = max(self.moves[:, x].max() - self.moves[:, OUT].min() + self.moves[x].max() - self.moves[OUT].min() for x in (BEGIN, INSIDE))
        unsure = scores[:, OUT] - scores[:, 1:].max(axis=1) <= max(reach, 0.0)
        at = np.flatnonzero(unsure)
        if not len(at):
            return tags
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(text[at]) != 0)])
        low = at[new]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        order = np.argsort(-size, kind="stable")
        low, size = low[order], size[order]
        inner_left = (low > 0) & (text[low - 1] == text[low])
        high = low + size
        inner_right = (high < n) & (text[np.minimum(high, n - 1)] == text[low])
        best = scores[low] + np.where(inner_left[:, None], self.moves[OUT], 0.0)
        came = np.zeros((len(at), 3), np.int8)
        offset, live, layers = 0, len(low), []
        final = np.zeros((len(low), 3))
        for step in range(int(size[0])):
            if step:
                ways = best[:live, :, None] + self.moves
                came[offset: offset + live] = ways.argmax(axis=1)
                best = ways.max(axis=1) + scores[low[:live] + step]
            layers.append((offset, live))
            offset += live
            still = int(np.searchsorted(-size, -(step + 1), side="left"))      # stretches longer than this step
            final[still:live] = best[still:live]
            live, best = still, best[:still]
        final += np.where(inner_right[:, None], self.moves[:, OUT], 0.0)
        tag = final.argmax(axis=1)
        for step in range(int(size[0]) - 1, -1, -1):
            offset, live = layers[step]
            tags[low[:live] + step] = tag[:live]
            if step:
                tag[:live] = came[offset + np.arange(live), tag[:live]]
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(windows: np.ndarray, tags: np.ndarray, valid: np.ndarray, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-4) -> Field:
    """Maximum conditional likelihood by forward-backward sums and adaptive steps.

    ``windows[s, t]`` are feature numbers, ``tags[s, t]`` labels; ``valid`` marks tokens inside the text, in one piece from the left.
    """
    s, t, k = windows.shape
    weights, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    gold = np.zeros((FEATURES, 3))
    hot = np.eye(3)[tags] * valid[..., None]
    flat = windows.reshape(s * t, k)
    for f in range(k):
        for c in range(3):
            gold[:, c] += np.bincount(flat[:, f], hot.reshape(-1, 3)[:, c], FEATURES)
    both = (valid[:, 1:] & valid[:, :-1])[..., None, None]
    gold_moves = (hot[:, :-1, :, None] * hot[:, 1:, None, :] * both).sum(axis=(0, 1))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        e = np.where(valid[..., None], weights[windows].sum(axis=2), 0.0)
        front, back = np.zeros((s, t, 3)), np.zeros((s, t, 3))
        front[:, 0] = e[:, 0]
        for i in range(1, t):
            ahead = _log_sum(front[:, i - 1, :, None] + moves, 1) + e[:, i]
            front[:, i] = np.where(valid[:, i, None], ahead, front[:, i - 1])
        for i in range(t - 2, -1, -1):
            behind = _log_sum(moves + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            back[:, i] = np.where(valid[:, i + 1, None], behind, 0.0)
        total = _log_sum(front[:, -1], 1)
        one = np.exp(front + back - total[:, None, None]) * valid[..., None]
        two = np.exp(front[:, :-1, :, None] + moves + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both
        expected = np.zeros_like(weights)
        for f in range(k):
            for c in range(3):
                expected[:, c] += np.bincount(flat[:, f], one.reshape(-1, 3)[:, c], FEATURES)
        for x, grad, m, v in ((weights, (expected - gold) / s + ridge * weights, first[0], second[0]),
                              (moves, (two.sum(axis=(0, 1)) - gold_moves) / s + ridge * moves, first[1], second[1])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(weights, moves)


def _windows(tokens: Tokens, tags: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = centres[:, None] + np.arange(-WINDOW, WINDOW + 1)
    low, high = tokens.bounds[tokens.text[centres]], tokens.bounds[tokens.text[centres] + 1]
    at = at + np.maximum(low - at[:, 0], 0)[:, None]
    return at, at < high[:, None], tags


def _text_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low])
        while high < len(texts) and size + len(texts[high]) <= CHUNK_CHARS:
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


def learn(texts: list[str]) -> Field | None:
    """A field from texts whose labels are their base spans; None if they hold none.

    Texts are read in chunks. Of the windows around secrets, around other odd tokens and around plain ones, those with the smallest
    random numbers are held, a third of ``FIT_WINDOWS`` each.
    """
    rng = np.random.default_rng(5)
    held: list[list[np.ndarray] | None] = [None] * 3
    for low, high in _text_chunks(texts):
        tokens = Tokens(texts[low:high])
        tags = tokens.labels([base_spans(t) for t in texts[low:high]])
        plain = tags == OUT
        odd = plain & (tokens.end - tokens.start >= 6) & np.isin(tokens.features[:, 1] - _OFFSETS[1], np.arange(6, 30))
        for kind, centres in enumerate(map(np.flatnonzero, (tags == BEGIN, odd, plain))):
            draw = rng.random(len(centres))
            own = np.argsort(draw)[:FIT_WINDOWS // 3]
            at, valid, _ = _windows(tokens, tags, centres[own])
            safe = np.clip(at, 0, max(len(tags) - 1, 0))
            new = [draw[own], tokens.features[safe], np.where(valid, tags[safe], OUT), valid]
            if held[kind] is not None:
                new = [np.concatenate(pair) for pair in zip(held[kind], new)]
                best = np.argsort(new[0])[:FIT_WINDOWS // 3]
                new = [x[best] for x in new]
            held[kind] = new
    if held[0] is None or not len(held[0][0]):
        return None
    return fit_field(*(np.concatenate(x) for x in list(zip(*held))[1:]))


def training_sample(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """``(text)``: at most ``rows`` texts, half of them with a secret and half without, as far as there are so many.

    Both halves are drawn from the whole table by a hash of id and text, so few secrets among very many documents are found, too.
    """
    draw = F.pmod(F.xxhash64(F.lit(23), F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(1 << 40))
    table = documents.select(F.col(f"`{text}`").alias("text"), draw.alias("draw")).filter(F.col("text").isNotNull())
    marked = F.col("text").rlike(HOLDS_SECRET)
    count = {r.marked: r["n"] for r in table.groupBy(marked.alias("marked")).agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = []
    for kind, half in ((True, rows // 2), (False, rows - rows // 2)):
        below = int(min(1.0, 1.2 * half / max(count.get(kind, 0), 1)) * (1 << 40))
        halves.append(table.filter((F.col("draw") < below) & (marked == F.lit(kind))).orderBy("draw", "text").limit(half))
    return halves[0].unionByName(halves[1]).select("text")


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Field | None:
    """Learn from ``training_sample``; the fit is one bounded task. None if no document holds a base span."""
    some = training_sample(documents, doc_id, text, rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = learn([t for batch in batches for t in batch.column(0).to_pylist()])
        if field is not None:
            held = io.BytesIO()
            np.savez_compressed(held, weights=field.weights, moves=field.moves)
            yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()])], names=["model"])

    found = some.repartition(1).sortWithinPartitions("text").mapInArrow(train, "model binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(bytes(found[0].model))) as saved:
        return Field(saved["weights"], saved["moves"])


def added_spans(texts: list[str], base: list[list[tuple]], field: Field | None) -> list[list[tuple]]:
    """Per text the field's ``(start, kind, end)`` that touch no base span."""
    out: list[list[tuple]] = [[] for _ in texts]
    if field is None:
        return out
    for low, high in _text_chunks(texts):
        tokens = Tokens(texts[low:high])
        tags = field.decode(field.scores(tokens.features), tokens.text)
        inside = np.flatnonzero(tags != OUT)
        for i, first in enumerate(inside):
            t = tokens.text[first]
            begins = tags[first] == BEGIN or i == 0 or inside[i - 1] != first - 1 or tokens.text[first - 1] != t
            start, end = int(tokens.start[first] - tokens.base[t]), int(tokens.end[first] - tokens.base[t])
            if begins:
                out[low + t].append((start, 3, end))
            else:
                out[low + t][-1] = (out[low + t][-1][0], 3, end)
        for t in range(low, high):
            if out[t] and base[t]:
                out[t] = [s for s in out[t] if all(s[2] <= b[0] or s[0] >= b[2] for b in base[t])]
    return out


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


def scan(documents: DataFrame, field: Field | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans``.

    ``base`` and ``spans`` list kind:start:end, in code points with the end exclusive, by start and then kind; ``spans``
    holds the field's additions too, those that touch no base span. NULL and empty texts have none; repeated rows get
    the same answer; without a field (nothing to learn from) ``spans`` is ``base``. Columns of those names are replaced.
    """
    names = ["n_assign", "n_access", "n_hex", "base", "spans"]
    keep = [c for c in keep if c not in names]
    table = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep),
                        "n_assign long, n_access long, n_hex long, base string, spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts = [t or "" for t in column[text].to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field)
            counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(3)]
            found = [*counts, pa.array([_joined(own) for own in base], pa.string()),
                     pa.array([_joined([(s[0], s[1], s[2]) for s in own] + extra) for own, extra in zip(base, more)], pa.string())]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in keep), *found], names=[*keep, *names])

    return table.mapInArrow(run, schema)
