"""Terms of a lexicon in word sequences, by an automaton that reads each text once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MAX_CHARS = 32 << 20        # characters of a lexicon that every task can hold as an automaton


class TermAutomaton:
    """Aho-Corasick over words: each word of a text is one step, whatever the number and length of the terms."""

    def __init__(self, terms: Iterable[str]):
        self.step: dict[tuple[int, str], int] = {}
        self.back, self.term, self.also = [0], [None], [0]     # by state: longest proper suffix, own term, next state on the way back with a term
        below: list[list[tuple[str, int]]] = [[]]
        for term in terms:
            state = 0
            for word in term.split(" "):
                after = self.step.get((state, word))
                if after is None:
                    after = self.step[state, word] = len(self.term)
                    below[state].append((word, after))
                    below.append([])
                    self.back.append(0)
                    self.term.append(None)
                    self.also.append(0)
                state = after
            self.term[state] = term
        waiting = deque(state for _, state in below[0])
        while waiting:
            state = waiting.popleft()
            for word, after in below[state]:
                self.back[after] = back = self._next(self.back[state], word)
                self.also[after] = back if self.term[back] is not None else self.also[back]
                waiting.append(after)

    def _next(self, state: int, word: str) -> int:
        while (after := self.step.get((state, word))) is None and state:
            state = self.back[state]
        return after or 0

    def found(self, words: Iterable[str | None]) -> set[str]:
        """The terms that occur; none goes over a NULL."""
        state, out = 0, set()
        for word in words:
            state = 0 if word is None else self._next(state, word)
            at = state if self.term[state] is not None else self.also[state]
            while at:
                out.add(self.term[at])
                at = self.also[at]
        return out


def detected_terms(lexicon: DataFrame, words: str) -> Column:
    """An array of ``(ord, aspect, forms)`` for a column of word arrays, from ``lexicon(term, aspect, ord)`` with one row per term.

    The lexicon goes to every executor: check its size before. A task builds the automaton once and reads each text once.
    """
    rows = lexicon.sparkSession.sparkContext.broadcast([tuple(r) for r in lexicon.select("term", "ord", "aspect").collect()])

    @F.pandas_udf("array<struct<ord: int, aspect: string, forms: array<string>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        owner = {term: (ord_, aspect) for term, ord_, aspect in rows.value}
        automaton = TermAutomaton(owner)
        for batch in batches:
            yield batch.map(lambda given: None if given is None else _grouped(automaton.found(given), owner))

    return run(F.col(words))


def _grouped(terms: set[str], owner: dict[str, tuple[int, str]]) -> list[dict]:
    forms: dict[tuple[int, str], list[str]] = {}
    for term in sorted(terms):
        forms.setdefault(owner[term], []).append(term)
    return [{"ord": o, "aspect": a, "forms": f} for (o, a), f in sorted(forms.items())]
