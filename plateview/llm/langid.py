"""Language identification by multinomial logistic regression on TF-IDF of character n-grams.

Letters in lower case, everything else a space; all 1-, 2- and 3-grams of a text fall into hashed features.
Document frequencies come from all learnable documents. The weights are fitted on a bounded sample by
follow-the-regularised-leader with an elastic-net penalty, which leaves most of them at zero; part of
the sample is kept out of the fit to choose the temperature of the probabilities.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plateview.llm.buffers import U64, mix, values

FEATURES = 1 << 15
FIT_ROWS = 6_000            # labelled documents that the weights are fitted on, at most, divided over the languages
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
CALIBRATION_SHARE = 0.2
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for point in range(0x110000):
            letter = chr(point)
            if letter.isalpha():
                low = letter.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _letters.append(table)
    return _letters[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features that occur and how often; none if the text has no letter."""
    points = _letter_table()[np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))].astype(U64)
    if len(points) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = points[:-1] * U64(0x1F3D5B79) + points[1:] + U64(1 << 62)
    triples = pairs[:-1] * U64(0x2545F4914F6CDD1D) + points[2:]
    codes = (mix(np.concatenate([points, pairs, triples])) & U64(FEATURES - 1)).view(np.int64)
    counts = np.bincount(codes, minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray         # features x languages
    bias: np.ndarray
    temperature: float

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _vector(self.idf, found, counts)

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = features(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        share = _softmax((self.vector(found, counts) @ self.weights[found] + self.bias) / self.temperature)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def _vector(idf: np.ndarray, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[found]
    return values / np.sqrt(values @ values)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``EPOCHS`` passes; rows are (features, values, class)."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            found, values, label = rows[i]
            at, x = np.append(found, FEATURES), np.append(values, 1.0)
            w = weights(at)
            gradient = _softmax(x @ w)
            gradient[label] -= 1.0
            g = x[:, None] * gradient
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives the held-out labels the greatest likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and the number of texts with a letter. At most ``FEATURES`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for value in values(batch.column(0)):
                found, _ = features(value)
                seen[found] += 1
                seen[FEATURES] += len(found) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for feature, n in texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n
    return out[:-1], int(out[-1])


def _sample(labelled: DataFrame, lang: str, text: str, rows: int) -> DataFrame:
    """At most ``rows`` texts, about as many of each language, chosen by a hash of the text; copies count once."""
    counts = labelled.groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    each = F.ceil(F.lit(rows) / F.greatest(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(1)))
    rates = counts.select("lang", (each * 1.3 / F.col("n")).alias("rate"), each.alias("each"))
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = (labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
            .join(F.broadcast(rates), "lang").withColumn("draw", draw).filter(F.col("draw") < F.col("rate"))
            .dropDuplicates(["lang", "text"]))      # copies are drawn together, and teach as one
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text")))
    return ranked.filter(F.col("place") <= F.col("each")).select("lang", "text")


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from rows with a language and a text. Rows without either teach nothing; no rows give a model without languages."""
    known = labelled.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    frequency, documents = document_frequencies(known, text)
    idf = np.log((1.0 + documents) / (1.0 + frequency)) + 1.0

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        pairs.sort()
        vectors = [(found, _vector(idf, found, counts), a) for a, b in pairs for found, counts in [features(b)] if len(found)]
        names = sorted({a for *_, a in vectors})
        data = [(found, values, names.index(a)) for found, values, a in vectors]
        aside = np.random.default_rng(3).random(len(data)) < CALIBRATION_SHARE
        w, bias = _ftrl([d for d, out in zip(data, aside) if not out], len(names))
        kept = [d for d, out in zip(data, aside) if out]
        logits = np.array([values @ w[found] + bias for found, values, _ in kept]).reshape(len(kept), len(names))
        held = io.BytesIO()
        np.savez_compressed(held, w=w.astype(np.float32), bias=bias, t=_temperature(logits, np.array([c for *_, c in kept], int)))
        yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([held.getvalue()])], names=["languages", "model"])

    fitted = _sample(known, lang, text, rows).repartition(1).mapInArrow(train, "languages array<string>, model binary").collect()
    if not fitted:
        return LanguageModel([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    with np.load(io.BytesIO(bytes(fitted[0].model))) as saved:
        return LanguageModel(list(fitted[0].languages), idf, saved["w"].astype(float), saved["bias"], float(saved["t"]))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 when divided by 4. A NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``lang_pred``, ``score``: the likeliest language and its calibrated probability.

    Only the text is looked at, all of it. NULL, empty and letterless texts, and every text under a model
    without languages, are ``und`` with score 0. Equal texts get equal answers. Own columns of those names are replaced.
    """
    keep = [c for c in (keep if keep is not None else documents.columns) if c not in ("lang_pred", "score")]
    table = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    schema = ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            answers = [model.predict(value) for value in values(column[text])]
            found = [pa.array([a for a, _ in answers], pa.string()), pa.array([b for _, b in answers], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in keep), *found], names=[*keep, "lang_pred", "score"])

    return table.mapInArrow(run, schema)
