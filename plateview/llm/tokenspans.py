"""Alignment of two tokenizers' tokens by the bytes that they cover, and how often their ids meet in the corpus.

A byte-level BPE tells the characters each token covers; where one token ends and the next begins at the same character, that is a
coarse cut; the spans of the other tokenizer's pieces are coarse cuts in bytes. Tokens that end inside a character have no such cut,
and byte-fallback tokens cover single bytes: both are placed by their decoded bytes, counted from the last coarse cut. A text counts
only if the decoded bytes of both tokenizers are the text's own.

Both tokenizers always end a token where a space follows a word, so distinct stretches between such places are aligned once per
few MB of text, and documents are lists of stretches.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from plateview.sources.scratch import stored

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_CHARS = 1 << 23       # text whose id pairs a task counts together
MOST_ROWS = 50_000
MOST_STRETCHES = 400_000    # distinct stretches that a task remembers from one block to the next
TOGETHER = 256              # words that are tokenized as one text
SPACE = "\u2581"            # stands for a space in pieces
_IDS = 1 << 20              # an id pair is first * _IDS + second; vocabularies are smaller

_DOCS = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bag binary, n_stretches long, pairs array<long>, counts array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_ODD_SPACE = re.compile(r"\s ")
_WORD_BORDER = re.compile(r"(?<=\S)(?= [\s\S])")

_loaded: dict = {}


def _letters() -> dict[str, int]:
    """Byte by the character that stands for it in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and, by id, the bytes that a token decodes to."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(f"{folder}/{BYTE_LEVEL}")
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        letters = _letters()
        self.first_bytes = [bytes(letters[c] for c in self.first.id_to_token(i)) for i in range(self.first.get_vocab_size())]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.is_byte = np.array([self.second.is_byte(i) for i in range(len(pieces))])
        self.second_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, byte in zip(pieces, self.is_byte)]
        self.first_length, self.second_length = (np.array([len(x) for x in y]) for y in (self.first_bytes, self.second_bytes))
        # Decimal ids with what follows them: "," in a list, "|" after the first ids of a group, ";" after the second, and a stretch's end.
        self.most = max(len(self.first_bytes), len(pieces))
        self.printed = [f"{i}{c}" for c in (",", "|", ";", ";\n") for i in range(self.most)]
        #: A piece that goes on after a space would tie words together.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    @staticmethod
    def load(folder: str) -> "Tokenizers":
        if folder not in _loaded:
            _loaded[folder] = Tokenizers(folder)
        return _loaded[folder]

    def words(self, text: str) -> list[str]:
        """The text in stretches that both tokenizers treat alone, each without the space before it.

        They begin at spaces between a character that is no white space and any other: no token of either goes on there, and the
        byte-level tokenizer's splitting rule looks at nothing before a space.
        """
        if not self.by_word:
            return [text]
        if _ODD_SPACE.search(text) is None and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [w[1:] for w in _WORD_BORDER.split(" " + text)]

    def align(self, words: list[str]) -> "Alignment":
        """How the tokens of stretches lie. Those that a tokenizer does not give back byte by byte are left out."""
        plain = [i for i, w in enumerate(words) if w.strip() == w] if self.by_word else []     # these may stand side by side
        alone = set(range(len(words))) - set(plain)
        groups = [plain[low: low + TOGETHER] for low in range(0, len(plain), TOGETHER)] + [[i] for i in sorted(alone)]
        kept = []
        while groups:
            texts = [" ".join([words[i] for i in g]) for g in groups]
            one = [self.first.encode(" " + t, add_special_tokens=False) for t in texts]
            two = self.second.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)
            wrong = []
            for g, t, x, y in zip(groups, texts, one, two):
                a, b, raw = x.ids, y["ids"], (" " + t).encode()
                if _joined(self.first_bytes, a) == raw and _joined(self.second_bytes, b) == raw:
                    kept.append((g, t, a, x.offsets, b, y["offsets"], len(raw)))
                elif len(g) > 1:
                    wrong += [[i] for i in g]
            groups = wrong
        if not kept:
            return Alignment([], np.zeros((0, 4), np.int64), np.zeros(0, np.int64), [])
        order = [i for g, *_ in kept for i in g]
        stop = np.cumsum([1 + len(words[i].encode()) for i in order])
        _, texts, a, offsets_a, b, offsets_b, size = zip(*kept)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(offsets_a)), np.int64, 2 * len(ids_a)).reshape(-1, 2)
        ends_a = self._first_ends(ids_a, spans, np.array([len(x) for x in a]), texts)
        inner = np.fromiter((end for x in offsets_b for _, end in x), np.int64, len(ids_b))
        # The spans of pieces leave out the first space.
        base = np.repeat(np.cumsum(size) - size, [len(x) for x in b])
        ends_b = _placed(inner + 1 + base, ~self.is_byte[ids_b], self.second_length[ids_b])
        every = np.concatenate([ends_a, ends_b])
        every.sort(kind="stable")       # two sorted runs
        twice = every[1:] == every[:-1]
        shared, every = every[1:][twice], every[np.append(True, ~twice)]
        links = ids_a[np.searchsorted(ends_a, every)] * _IDS + ids_b[np.searchsorted(ends_b, every)]
        numbers = np.stack([np.diff(np.searchsorted(x, stop, side="right"), prepend=0) for x in (ends_a, ends_b, shared, every)], axis=1)
        return Alignment(order, numbers, links, self._print(ids_a, ends_a, ids_b, ends_b, shared, stop))

    def _first_ends(self, ids: np.ndarray, spans: np.ndarray, count: np.ndarray, texts: tuple[str, ...]) -> np.ndarray:
        """Byte ends from character spans; of tokens that end inside a character, by decoded bytes from the last coarse cut."""
        points = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        base = np.cumsum([0] + [1 + len(t) for t in texts])[:-1]
        spans = spans + np.repeat(base, count)[:, None]
        cut = np.append(spans[1:, 0] >= spans[:-1, 1], True)
        return _placed(np.concatenate([[0], np.cumsum(width)])[spans[:, 1]], cut, self.first_length[ids])

    def _print(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, shared: np.ndarray, stop: np.ndarray) -> list[str]:
        """The groups of each stretch as text, each group ending in ``;``."""
        in_a, in_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        upto_a, upto_b = np.searchsorted(ends_a, shared, side="right"), np.searchsorted(ends_b, shared, side="right")
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], upto_b])[in_a]] = a + self.most * (ends_a == shared[in_a])
        last = np.zeros(len(b), np.int64)
        last[np.searchsorted(ends_b, stop)] = 1
        code[np.arange(len(b)) + upto_a[in_b]] = b + self.most * (2 * (ends_b == shared[in_b]) + last)
        return "".join(itemgetter(*code.tolist())(self.printed)).split("\n")[:-1]


class Alignment(NamedTuple):
    """Places of the stretches that are right; of those, numbers of tokens of both sides, groups and links, the links' id pairs, the groups as text."""

    order: list[int]
    numbers: np.ndarray
    links: np.ndarray
    printed: list[str]


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join([table[i] for i in ids])


def _placed(ends: np.ndarray, cut: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ends where there is a coarse cut; elsewhere the end of the last cut before and the lengths since."""
    if cut.all():
        return ends
    total = np.cumsum(length)
    last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
    base = np.where(last >= 0, ends[last] - total[last], 0)
    return np.where(cut, ends, total + base)


def _zipped(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(x.astype(np.uint32).tobytes() for x in arrays), 1)


def _unzipped(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)


class _Block:
    """Documents of a task as places in the distinct stretches of a few MB of text. Stretches stay known from block to block, up to a number."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self._forget()
        self._next()

    def _forget(self) -> None:
        self.place, self.links, self.numbers, self.printed = {}, [], [], []

    def _next(self) -> None:
        self.rows, self.size = [], 0
        if len(self.printed) > MOST_STRETCHES:
            self._forget()

    def add(self, ids: list, texts: list) -> None:
        split = [self.tok.words(t) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(split)).difference(self.place))
        for low in range(0, len(fresh), 8 * TOGETHER):
            some = fresh[low: low + 8 * TOGETHER]
            found = self.tok.align(some)
            self.place.update(dict.fromkeys(some, -1))
            self.place.update(zip([some[i] for i in found.order], range(len(self.printed), len(self.printed) + len(found.order))))
            self.links.append(found.links)
            self.numbers.append(found.numbers.astype(np.int32))
            self.printed += found.printed
        for doc_id, words, text in zip(ids, split, texts):
            self.size += len(text or "")
            own = [self.place[w] for w in words]
            whole = bool(own) and min(own) >= 0
            digest = hashlib.sha256("".join([self.printed[i] for i in own])[:-1].encode()).hexdigest() if whole else ""
            self.rows.append((doc_id, digest, np.array(own if whole else [], np.int32)))

    def batch(self) -> pa.RecordBatch:
        """The documents since the last one, and the stretches that they use."""
        n, known = len(self.rows), np.concatenate([np.zeros((0, 4), np.int64), *self.numbers])
        used, own = np.unique(np.concatenate([np.zeros(0, np.int64), *(r[2] for r in self.rows)]), return_inverse=True)
        owns = np.split(own, np.cumsum([len(r[2]) for r in self.rows])[:-1])
        numbers, end = known[used], np.cumsum(known[:, 3])[used]
        length = numbers[:, 3]
        links = np.concatenate([np.zeros(0, np.int64), *self.links])
        flat = links[np.repeat(end - np.cumsum(length), length) + np.arange(length.sum())]
        self.numbers, self.links = [known], [links]
        pairs, place = np.unique(flat, return_inverse=True)
        often = np.bincount(own, minlength=len(numbers))
        counts = np.bincount(place, weights=np.repeat(often, length), minlength=len(pairs)).astype(np.int64)
        sums = np.array([numbers[x].sum(axis=0) for x in owns]).reshape(-1, 4)
        bags = [_zipped(np.diff(np.sort(x), prepend=0)) for x in owns] + [_zipped(length, place)]
        name = uuid.uuid4().hex
        made = pa.RecordBatch.from_arrays(
            [pa.array([name] * (n + 1)), pa.array([r[0] for r in self.rows] + [None], pa.int64()),
             *(pa.array([int(x) for x in sums[:, i]] + [None], pa.int64()) for i in range(4)),
             pa.array([r[1] for r in self.rows] + [None], pa.string()), pa.array(bags, pa.binary()),
             pa.array([len(numbers)] * n + [None], pa.int64()),
             pa.array([None] * n + [pairs], pa.list_(pa.int64())), pa.array([None] * n + [counts], pa.list_(pa.int64()))],
            names=[c.split()[0] for c in _DOCS.split(", ")])
        self._next()
        return made


def _aligned(folder: str, block_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers.load(folder)
        block = _Block(tok)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                block.add(*(c.slice(low, 64).to_pylist() for c in batch.columns))
                if block.size >= block_chars or len(block.rows) >= MOST_ROWS:
                    yield block.batch()
        if block.rows:
            yield block.batch()
    return run


def _judged(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block from the corpus-wide counts of the block's pairs."""
    order = np.argsort(np.asarray(told.column("pair")))
    weights = np.stack([np.asarray(told.column(c)).astype(np.int64)[order] for c in ("best", "count")], axis=1)
    is_doc = docs.column("n_links").is_valid()
    stretches = _unzipped(docs.filter(pc.invert(is_doc)).column("bag")[0].as_py())
    docs = docs.filter(is_doc)
    many = docs.column("n_stretches")[0].as_py()
    length, place = stretches[:many], stretches[many:]
    whole = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(weights[place], axis=0)])
    to = np.cumsum(length)
    own = whole[to] - whole[to - length]
    sums = [own[np.cumsum(_unzipped(bag.as_py()))].sum(axis=0) for bag in docs.column("bag")]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return (out.append_column("n_best", pa.array([int(x[0]) for x in sums], pa.int64()))
            .append_column("count_sum", pa.array([int(x[1]) for x in sums], pa.int64()))
            .append_column("groups_sha256", docs.column("groups_sha256")))


def aligned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    A link is a pair of tokens whose bytes overlap, a group what lies between two byte ends common to both tokenizers. Each
    link weighs the number of links of its two ids in all documents; ``n_best`` counts those of which no other first id has
    more with the same second id. NULL and empty texts, and those that a tokenizer does not give back byte by byte, have zeros and an
    empty digest. Repeated rows count each time; doc_id may be NULL. An empty table gives no rows.

    A task counts the id pairs of about ``block_chars`` of text together; what travels is one row for each pair of a
    block, and each document as places among the stretches of its block. The tokenizers' files are read from ``folder``
    on every executor.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    table = stored(rows.mapInArrow(_aligned(folder, block_chars), _DOCS), "aligned")
    pairs = table.filter(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = stored(pair_totals(pairs), "pairs")
    told = pairs.select("block", "pair").join(totals, "pair").select("block", "pair", "count", "best")
    told = told.withColumnRenamed("block", "_block")
    docs = table.drop("pairs", "counts")
    return docs.groupBy("block").cogroup(told.groupBy("_block")).applyInArrow(_judged, _RESULT)


def pair_totals(pairs: DataFrame) -> DataFrame:
    """``(pair, count, best)`` of ``pairs(pair, n)``: links of an id pair, and 1 if its second id has no pair with more."""
    whole = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair") % F.lit(_IDS)
    return whole.select("pair", "count", (F.col("count") == F.max("count").over(Window.partitionBy(second))).cast("int").alias("best"))
