"""Sentiment of (context, aspect) pairs.

Two scorers. ``BayesScorer`` is relational: class weights per term, learned from labelled texts, averaged over
the context with more weight near the aspect's mentions. It looks a text's terms up once, whatever
the number of aspects and contexts asked about. ``BatchScorer`` calls any user-supplied model in batches.
A scorer's ``score`` takes a table of contexts and key columns and returns the keys, the
class id and the confidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plateview.functions import text as tx
from plateview.functions import vectors as vx
from plateview.functions.rows import each, settled
from plateview.operators.features import top_terms
from plateview.operators.joins import lookup_join, lookup_value, looked_up
from plateview.operators.ratings import text_key
from plateview.schemas import BLOCK_TOKENS, LABEL_NAMES, MAX_INROW_BYTES, SCORING_BATCH
from plateview.sources.scratch import measured_bytes, stored

_WORDS = re.compile(r"[^\W]{2,}")       # letters, digits and the underscore, as in text.WORD


def named(class_id: Column, names: list[str]) -> Column:
    return tx.capitalize(F.get(F.array(*[F.lit(n) for n in names]), class_id))


def most_probable(scores: Column) -> tuple[Column, Column]:
    """Class id and confidence, to four places, of an array of scores (column reference)."""
    return vx.argmax(scores), F.round(F.array_max(vx.softmax(scores)), 4)


# --- naive Bayes ----------------------------------------------------------------------

def bayes_weights(texts: DataFrame, text: str, label: str, classes: list[int], vocab_size: int | None = None) -> DataFrame:
    """``(term, tf, lw_<class>...)``: Laplace-smoothed log weights of the uni- and bigrams; of the most frequent ones if a size is given.

    The counts are stored, so the texts are tokenised once for the rows and the totals together.
    """
    tokens = texts.select(F.col(label).alias("_c"), tx.words(tx.light_clean(F.col(text))).alias("_tokens"))
    terms = each(tokens, ["_c"], tx.unigrams_and_bigrams(F.col("_tokens")), "term")
    counts = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("tf"), *[F.count(F.when(F.col("_c") == c, 1)).alias(f"n_{c}") for c in classes])
    kept = stored(counts if vocab_size is None else top_terms(counts, vocab_size), "counts")
    totals = kept.agg(F.struct(F.count(F.lit(1)).alias("v"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in classes])).scalar()
    return (kept.withColumn("_all", totals)
            .select("term", "tf", *[F.log((F.col(f"n_{c}") + F.lit(1.0)) / (F.col(f"_all.n_{c}") + F.col("_all.v"))).alias(f"lw_{c}")
                                    for c in classes]))


def bayes_priors(texts: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """One row ``(prior_<class>...)`` of smoothed log class shares."""
    return texts.agg(*[F.log((F.sum(F.when(F.col(label) == c, 1).otherwise(0)) + F.lit(1.0))
                             / (F.count(F.lit(1)) + F.lit(len(classes)))).alias(f"prior_{c}") for c in classes])


def _upto(last: Column) -> Column:
    """0, 1, ... last; empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _located(rows: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """Adds ``_flat``, the tokens of all lists, and to every ask the places of its context's tokens and its bigrams across a gap."""
    lists = F.transform("_lists", lambda part: F.coalesce(part, F.array().cast("array<string>")))
    flat = F.flatten(F.transform(lists, lambda part, i: F.transform(part, lambda t: F.struct(i.alias("s"), t.alias("t")))))
    base = settled(rows, [*keep, "_asks"], F.struct(F.coalesce(flat, F.array().cast("array<struct<s:int,t:string>>")).alias("_flat")))
    base = settled(base, [*keep, "_asks", "_flat"], F.struct(_upto(F.size("_flat") - 1).alias("_every")))
    whole, tokens = F.col("_every"), F.col("_flat")

    def kept(a: Column) -> list[Column]:
        return [a[f].alias(f) for f in [*fields, "forms"]]

    def places(a: Column) -> Column:
        chosen = F.filter(whole, lambda p: F.get(a["which"], F.get(tokens, p)["s"]))
        return F.struct(*kept(a), F.when(a["which"].isNull(), whole).otherwise(chosen).alias("at"))

    def gaps(a: Column) -> Column:
        jumps = F.filter(_upto(F.size(a["at"]) - 2), lambda c: F.get(a["at"], c + 1) != F.get(a["at"], c) + 1)
        return F.struct(*kept(a), a["at"].alias("at"), jumps.alias("jumps"))

    def bridged(a: Column) -> Column:
        across = F.transform(a["jumps"], lambda c: F.concat(
            F.get(tokens, F.get(a["at"], c))["t"], F.lit(" "), F.get(tokens, F.get(a["at"], c + 1))["t"]))
        return F.struct(*kept(a), a["at"].alias("at"), a["jumps"].alias("jumps"), across.alias("across"))

    asks = F.transform(F.transform(F.transform("_asks", places), gaps), bridged)
    return settled(base, [*keep, "_flat"], F.struct(asks.alias("_asks")))


# --- the terms and sums of a block of texts -------------------------------------------

def _lengths(lists) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and the range that each belongs to."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    return (starts - _starts(lengths))[owner] + np.arange(len(owner)), owner


class _Contexts:
    """The contexts that are asked about in a block of texts, whose parts are tokens joined by blanks: numbers of tokens, some at a time."""

    def __init__(self, lists, asks):
        import pyarrow as pa
        import pyarrow.compute as pc

        lists, asks = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (lists, asks))
        parts = pc.fill_null(pc.list_flatten(lists), "")
        split = pc.split_pattern(parts, " ")
        tokens = pc.list_flatten(split)
        tokens = tokens.filter(pc.not_equal(tokens, "")).dictionary_encode()
        self.tokens, self.words = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), tokens.dictionary
        self.asks, self.owner = pc.list_flatten(asks), pc.list_parent_indices(asks)
        self.part_size = np.where(pc.equal(parts, "").to_numpy(zero_copy_only=False), 0, _lengths(split))
        of_text, which, owner = _lengths(lists), self.asks.field("which"), self.owner.to_numpy(zero_copy_only=False)
        part, ask = _ranges(_starts(of_text)[owner], of_text[owner])
        sizes, place = _lengths(which), part - _starts(of_text)[owner[ask]]
        flags = np.append(pc.fill_null(pc.list_flatten(which), False).to_numpy(zero_copy_only=False).astype(bool), False)
        named = flags[np.where(place < sizes[ask], _starts(sizes)[ask] + place, len(flags) - 1)]
        chosen = named | which.is_null().to_numpy(zero_copy_only=False).astype(bool)[ask]
        self.part, self.ask = part[chosen], ask[chosen]

    def __iter__(self):
        """``(places, ask)``: the tokens of contexts in their order, and whose context it is; whole contexts, together about ``BLOCK_TOKENS``."""
        starts, sizes = _starts(self.part_size), self.part_size[self.part]
        per_ask = np.bincount(self.ask, sizes, len(self.asks)).astype(np.int64)
        turn = (_starts(per_ask) // BLOCK_TOKENS)[self.ask]
        for t in np.unique(turn):
            now = turn == t
            places, owner = _ranges(starts[self.part[now]], sizes[now])
            yield places, self.ask[now][owner]

    def pairs(self, places: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``places`` a bigram starts, and its two words as one number."""
        first = np.flatnonzero(ask[1:] == ask[:-1])
        return first, self.tokens[places[first]] * len(self.words) + self.tokens[places[first + 1]]

    def bigrams(self, pairs: np.ndarray):
        import pyarrow.compute as pc

        return pc.binary_join_element_wise(self.words.take(pairs // len(self.words)), self.words.take(pairs % len(self.words)), " ")

    def nearness(self, places: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """1 / (1 + distance to the nearest word of the ask's forms, in the context) of every token; 1 if none occurs there."""
        import pyarrow as pa
        import pyarrow.compute as pc

        forms = self.asks.field("forms")
        split = pc.split_pattern(pc.fill_null(pc.list_flatten(forms), ""), " ")
        code = pc.fill_null(pc.index_in(pc.list_flatten(split), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        asking = pc.list_parent_indices(forms).take(pa.array(np.repeat(np.arange(len(split)), _lengths(split)))).to_numpy(zero_copy_only=False)
        here = np.isin(ask * len(self.words) + self.tokens[places], (asking * len(self.words) + code)[code >= 0])
        at, none = np.arange(len(places)), 2 * len(places) + 1
        before = np.maximum.accumulate(np.where(here, at, -1))
        after = np.minimum.accumulate(np.where(here, at, len(places))[::-1])[::-1]
        left = np.where((before >= 0) & (ask[before] == ask), at - before, none)
        right = np.where((after < len(places)) & (ask[np.minimum(after, len(places) - 1)] == ask), after - at, none)
        distance = np.minimum(left, right)
        return np.where(distance == none, 1.0, 1.0 / (1.0 + distance))


def _block_terms(batches):
    """``(_block, term)``: the distinct uni- and bigrams of the contexts that are asked about; a block in several batches may repeat some."""
    import pyarrow as pa

    for batch in batches:
        blocks = batch.column("_block").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for first, end in zip(edges, edges[1:]):
            if first == end:
                continue
            part = batch.slice(first, end - first)
            contexts = _Contexts(part.column("_lists"), part.column("_asks"))
            words, pairs = np.zeros(len(contexts.words), dtype=bool), np.zeros(0, dtype=np.int64)
            for places, ask in contexts:
                words[contexts.tokens[places]] = True
                pairs = np.union1d(pairs, contexts.pairs(places, ask)[1])
            for terms in (contexts.words.filter(pa.array(words)), contexts.bigrams(pairs)):
                if len(terms):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), blocks[first])), terms], ["_block", "term"])


def _block_sums(keep: list[str], fields: list[str], sums: list[str]) -> Callable:
    """A function of a block of texts and its known terms: a row per ask, its total of weights and its weighted sums."""
    def summed(texts, known):
        import pyarrow as pa
        import pyarrow.compute as pc

        contexts = _Contexts(texts.column("_lists"), texts.column("_asks"))
        terms, values = known.column("term").combine_chunks(), pc.list_flatten(known.column("lw")).to_numpy()
        weights = np.append(values, np.zeros(len(sums) - 1)).reshape(-1, len(sums) - 1)      # the last row: unknown

        def found(some) -> np.ndarray:
            return pc.fill_null(pc.index_in(some, value_set=terms), len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)

        single, totals = found(contexts.words), np.zeros((len(sums), len(contexts.asks)))
        for places, ask in contexts:
            near = contexts.nearness(places, ask)
            first, pairs = contexts.pairs(places, ask)
            distinct, back = np.unique(pairs, return_inverse=True)
            for row, w, a in ((single[contexts.tokens[places]], near, ask), (found(contexts.bigrams(distinct))[back], near[first], ask[first])):
                totals[0] += np.bincount(a, w * (row < len(terms)), len(contexts.asks))
                for c in range(len(sums) - 1):
                    totals[c + 1] += np.bincount(a, w * weights[row, c], len(contexts.asks))
        columns = [*[texts.column(c).take(contexts.owner) for c in keep], *[contexts.asks.field(f) for f in fields], *[pa.array(x) for x in totals]]
        return pa.table(columns, names=[*keep, *fields, *sums])
    return summed


@dataclass
class BayesScorer:
    """Distance-weighted naive Bayes over a table of term weights of any size."""

    weights: DataFrame
    priors: DataFrame
    classes: list[int]
    names: list[str]

    @classmethod
    def fit(cls, texts: DataFrame, text: str, label: str, names: dict[int, str] | None = None,
            vocab_size: int | None = None) -> BayesScorer:
        """Learn from all terms, or from the ``vocab_size`` most frequent ones."""
        names = LABEL_NAMES if names is None else names
        classes = sorted(names)
        return cls(bayes_weights(texts, text, label, classes, vocab_size), bayes_priors(texts, label, classes),
                   classes, [names[c] for c in classes])

    def materialised(self) -> BayesScorer:
        """The same scorer with its two tables stored, so that scoring does not learn them again."""
        return replace(self, weights=stored(self.weights, "weights"), priors=stored(self.priors, "priors"))

    def score(self, contexts: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
        """``keys``, ``carry``, ``class_id, confidence, label`` of contexts ``(keys, context, forms)``; ``carry`` may be of any type."""
        carry = carry or []
        ask = F.struct("forms", F.lit(None).cast("array<boolean>").alias("which"))
        rows = contexts.select(*keys, *carry, F.array(tx.words(F.col("context"))).alias("_lists"), F.array(ask).alias("_asks"))
        return self.score_asks(rows, keys, [], carry)

    def score_asks(self, rows: DataFrame, keys: list[str], fields: list[str], carry: list[str]) -> DataFrame:
        """A row per element of ``_asks``: ``keys``, ``carry``, its ``fields``, ``class_id, confidence, label``.

        ``_lists`` are the tokens of a text in parts. An ask names the ``forms`` of an aspect and, in ``which``, the parts that make up its context
        (NULL: all). The text's uni- and bigrams are looked up once for all asks: inside the row if the weights are a small
        table by measured bytes, otherwise by a join of the distinct terms of a block of texts. Both give the same rows.
        """
        rows = rows.select(*keys, *carry, "_lists", "_asks")
        if measured_bytes(self.weights) <= MAX_INROW_BYTES:
            located = _located(rows, [*keys, *carry], fields)
            sums = self._summed(self._looked_up_in_row(located, [*keys, *carry], fields), [*keys, *carry], fields)
        else:
            sums = self._summed_by_join(rows, keys, carry, fields)
        prior = self.priors.select(F.struct(*self.priors.columns)).scalar()
        # The prior counts as one more term of weight 1; rounding makes ties exact.
        scores = F.array(*[F.round((F.col(f"_prior.prior_{c}") + F.col(f"_s_{c}")) / (1.0 + F.col("_total")), 9)
                           for c in self.classes])
        best, confidence = most_probable(F.col("_scores"))
        judged = settled(sums.withColumn("_prior", prior).withColumn("_scores", scores), [*keys, *carry, *fields],
                         F.struct(best.alias("class_id"), confidence.alias("confidence")))
        return judged.withColumn("label", named(F.col("class_id"), self.names))

    def _weight(self) -> Column:
        return F.array(*[f"lw_{c}" for c in self.classes])

    @staticmethod
    def _answered(fields: list[str], across) -> Callable[[Column, Column], Column]:
        return lambda a, k: F.struct(*[a[f].alias(f) for f in fields], *[a[f].alias(f"_{f}") for f in ("forms", "at", "jumps")], across(a, k).alias("_across"))

    def _looked_up_in_row(self, located: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
        slots = max(1, self.weights.count() // 4)

        def weight(term: Column) -> Column:
            return looked_up(F.col("_weights"), term, slots)

        following = lambda i: F.get(F.col("_flat"), i + 1)["t"]
        found = F.struct(
            F.transform("_flat", lambda x: weight(x["t"])).alias("_one"),
            F.transform("_flat", lambda x, i: weight(F.concat(x["t"], F.lit(" "), following(i)))).alias("_two"),
            F.transform("_asks", self._answered(fields, lambda a, k: F.transform(a["across"], weight))).alias("_asked"))
        return settled(located.withColumn("_weights", lookup_value(self.weights, "term", self._weight(), slots)), [*keep, "_flat"], found)

    def _summed_by_join(self, rows: DataFrame, keys: list[str], carry: list[str], fields: list[str]) -> DataFrame:
        """As ``_summed``, for weights of any size: every block of texts meets the weights of its own distinct terms.

        Only the distinct terms of the asked contexts travel to the weights and back, a term once a block; the texts move once, to their block,
        with the tokens of a part as one string. A block holds consecutive rows, about ``BLOCK_TOKENS`` tokens by the average of all texts.
        """
        joined = rows.withColumn("_lists", F.transform("_lists", lambda part: F.array_join(part, " ")))
        located = stored(joined.withColumn("_row", F.monotonically_increasing_id()), "located")

        def counted(total: Column, part: Column) -> Column:
            return total + F.when(F.length(part) > 0, F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))) + 1).otherwise(0)

        n_rows, n_tokens = located.agg(F.count(F.lit(1)), F.sum(F.aggregate("_lists", F.lit(0), counted).cast("bigint"))).first()
        bits = max(0, math.floor(math.log2(max(1.0, BLOCK_TOKENS * n_rows / max(1, n_tokens or 0)))))
        located = located.select(F.shiftright("_row", bits).alias("_block"), *keys, *carry, "_lists", "_asks")
        terms = located.select("_block", "_lists", "_asks").mapInArrow(_block_terms, "_block long, term string")
        known = lookup_join(terms, self.weights.select("term", self._weight().alias("lw")), ["term"]).select("_block", "term", "lw")
        ask = located.schema["_asks"].dataType.elementType
        sums = [T.StructField(n, T.DoubleType()) for n in ["_total", *[f"_s_{c}" for c in self.classes]]]
        schema = T.StructType([*[located.schema[c] for c in [*keys, *carry]], *[T.StructField(f, ask[f].dataType) for f in fields], *sums])
        return located.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(
            _block_sums([*keys, *carry], fields, [f.name for f in sums]), schema)

    def _summed(self, known: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
        """Weighted sums of the class weights of each ask.

        A term at distance d from the nearest mention of the aspect, in its context, has weight 1 / (1 + d); without a
        mention all weights are 1. Each mention owns the stretch of the context nearer to it than to
        its neighbours, so the work is linear in the length of the context.
        """
        asked = [*keep, *fields, "_one", "_two", "_at", "_jumps", "_across"]
        table = known.select(*keep, "_flat", "_one", "_two", F.inline_outer("_asked")).filter(F.col("_at").isNotNull())
        at, tokens = F.col("_at"), F.col("_flat")
        words = F.array_distinct(F.split(F.array_join("_forms", " "), " "))
        table = settled(table, [*asked, "_flat"], F.struct(words.alias("_words")))
        mentioned = F.filter(F.transform(at, lambda p, c: F.when(F.array_contains("_words", F.get(tokens, p)["t"]), c)), lambda c: c.isNotNull())
        table = settled(table, asked, F.struct(mentioned.alias("_here")))
        here, size = F.col("_here"), F.size(at)

        def stretch(m: Column, i: Column) -> Column:
            first = F.when(i == 0, F.lit(0)).otherwise(F.floor((F.get(here, i - 1) + m) / 2).cast("int") + 1)
            last = F.when(i == F.size(here) - 1, size - 1).otherwise(F.floor((m + F.get(here, i + 1)) / 2).cast("int"))
            return F.struct(m.alias("m"), first.alias("first"), last.alias("last"))

        def grams(s: Column) -> Column:
            def at_place(c: Column) -> Column:
                w = F.coalesce(1.0 / (1.0 + F.abs(c - s["m"])), F.lit(1.0))
                p, following = F.get(at, c), F.get(at, c + 1)
                return F.array(F.struct(w.alias("w"), F.get("_one", p).alias("lw")),
                               F.struct(w.alias("w"), F.when(following == p + 1, F.get("_two", p)).alias("lw")))
            return F.flatten(F.transform(F.sequence(s["first"], s["last"]), at_place))

        def bridge(c: Column, k: Column) -> Column:
            near = F.array_min(F.transform(here, lambda m: F.abs(c - m)))
            return F.struct(F.coalesce(1.0 / (1.0 + near), F.lit(1.0)).alias("w"), F.get("_across", k).alias("lw"))

        whole = F.array(F.struct(F.lit(None).cast("int").alias("m"), F.lit(0).alias("first"), (size - 1).alias("last")))
        stretches = F.when(F.size(here) > 0, F.transform(here, stretch)).otherwise(whole)
        every = F.when(size > 0, F.concat(F.flatten(F.transform(stretches, grams)), F.transform(F.col("_jumps"), bridge)))
        table = settled(table, [*keep, *fields], F.struct(F.filter(every, lambda x: x["lw"].isNotNull()).alias("_known")))

        def total(of) -> Column:
            return F.coalesce(F.aggregate("_known", F.lit(0.0), lambda acc, x: acc + of(x)), F.lit(0.0))

        return table.select(*keep, *fields, total(lambda x: x["w"]).alias("_total"),
                            *[total(lambda x, i=i: x["w"] * F.get(x["lw"], F.lit(i))).alias(f"_s_{c}") for i, c in enumerate(self.classes)])


# --- any batch model ------------------------------------------------------------------

@dataclass
class BatchScorer:
    """A model behind a function: ``make_predict`` is called once per Python worker and returns
    ``predict(contexts, aspects) -> logits``, a float array of shape (batch, classes)."""

    make_predict: Callable
    names: list[str]
    batch_size: int = SCORING_BATCH
    distinct_pairs: bool = False

    def _logits(self, context: Column, aspect: Column) -> Column:
        predict = predict_batch_udf(self.make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=self.batch_size)
        return vx.as_double(predict(context, aspect))

    def _decided(self, table: DataFrame) -> DataFrame:
        best, confidence = most_probable(F.col("_logits"))
        return (table.withColumn("class_id", best).withColumn("confidence", confidence)
                .withColumn("label", named(F.col("class_id"), self.names)).drop("_logits"))

    def score(self, contexts: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
        """Adds ``class_id, confidence, label`` per key.

        Contexts are scored where they are. With ``distinct_pairs``, for models so dear that this pays, equal pairs are sent to the model
        once: the contexts are stored, a hash and the least key stand for them in the grouping, and only the chosen rows' texts move.
        """
        carry = carry or []
        aspect, context = F.col("aspect"), F.col("context")
        if not self.distinct_pairs:
            return self._decided(contexts.withColumn("_logits", self._logits(context, aspect))).select(
                *keys, *carry, "class_id", "confidence", "label")
        keyed = stored(contexts.withColumn("_pair", text_key(F.concat_ws("\x01", aspect, context))), "pairs")
        least = keyed.groupBy("_pair").agg(F.min(F.struct(*keys)).alias("_k")).select("_pair", "_k.*")
        chosen = keyed.select("_pair", *keys, "context", "aspect").join(least, ["_pair", *keys], "left_semi") if "aspect" not in keys else \
            keyed.select("_pair", *keys, "context").join(least, ["_pair", *keys], "left_semi")
        scored = self._decided(chosen.withColumn("_logits", self._logits(context, aspect))).select("_pair", "class_id", "confidence", "label")
        return lookup_join(keyed.select(*keys, *carry, "_pair"), scored, ["_pair"]).select(*keys, *carry, "class_id", "confidence", "label")


class StepPredictor:
    """``make_predict`` for ``BatchScorer`` from a ``gradient.StepModel``: the coefficients go to every executor once, as arrays by term.

    A context is scored by its TF-IDF weights of uni- and bigrams, as in training; the aspect plays no part. The model is a top-k of terms.
    """

    def __init__(self, model):
        last = F.max("i").over(Window.partitionBy())
        rows = (model.weights.select("i", "w", (F.col("i") == last).alias("_last")).join(model.vocabulary, "i", "left")
                .select("_last", "term", "idf", "w").collect())
        known = sorted((r for r in rows if not r._last), key=lambda r: r.term)
        place = {r.term: i for i, r in enumerate(known)}
        idf = np.array([r.idf for r in known], dtype=np.float64)
        weights = np.array([r.w for r in known], dtype=np.float64).reshape(len(known), len(model.classes))
        bias = next((np.array(r.w) for r in rows if r._last), np.zeros(len(model.classes)))
        self.held = model.weights.sparkSession.sparkContext.broadcast((place, idf, weights, bias))

    def __call__(self) -> Callable:
        place, idf, weights, bias = self.held.value
        after: dict[str, dict[str, int]] = {}       # by first word: second words of the bigrams
        for term, i in place.items():
            first, _, second = term.partition(" ")
            if second:
                after.setdefault(first, {})[second] = i

        def logits(text: str | None) -> np.ndarray:
            words = _WORDS.findall((text or "").lower())
            spots = [i for i in map(place.get, words) if i is not None]
            spots += [after[a][b] for a, b in zip(words, words[1:]) if a in after and b in after[a]]
            if not spots:
                return bias
            at, counts = np.unique(np.array(spots), return_counts=True)
            raw = counts * idf[at]
            return bias + (raw / math.sqrt(float(raw @ raw))) @ weights[at]

        return lambda contexts, aspects: np.array([logits(c) for c in contexts], dtype=np.float64)
