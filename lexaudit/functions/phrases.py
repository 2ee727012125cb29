"""Longest phrase at each token (TOK6): an Aho-Corasick automaton over the
normalised surfaces of a document, stepped once per token.

A match must begin where a token begins and end where one ends, and never
crosses an empty surface. Matches are reported by their end; as ends come in
order, the last one noted for a begin is the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import SparkSession

# Characters of the phrases in one automaton (some 120 bytes each in a task).
# More phrases are dealt to several automata, one pass each.
PHRASE_CHARS = 2_000_000
MEMO = 1 << 16


class PhraseAutomaton:
    """States are numbers, 0 is the root. ``goto`` maps (state, character) to
    a state, ``fail`` a state to its longest proper suffix that is a state,
    ``length`` a state to the length of the phrase it ends (0: none), ``link``
    a state to the next shorter phrase that ends with it."""

    def __init__(self, phrases: Iterable[str]):
        self.goto: dict[int, int] = {}
        self.length, depth, edges = [0], [0], []
        for phrase in phrases:
            state = 0
            for char in phrase:
                key = state << 21 | ord(char)
                if key not in self.goto:
                    self.goto[key] = len(depth)
                    edges.append((depth[state], state, ord(char), len(depth)))
                    depth.append(depth[state] + 1)
                    self.length.append(0)
                state = self.goto[key]
            self.length[state] = len(phrase)
        self.fail, self.link = [0] * len(depth), [0] * len(depth)
        for above, parent, char, state in sorted(edges):
            suffix = self._next(self.fail[parent], char) if above else 0
            self.fail[state] = suffix
            self.link[state] = suffix if self.length[suffix] else self.link[suffix]
        self.memo: dict[tuple[int, str], int] = {}

    def _next(self, state: int, char: int) -> int:
        while True:
            to = self.goto.get(state << 21 | char)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.fail[state]

    def step(self, state: int, surface: str) -> int:
        """The state after a whole surface."""
        to = self.memo.get((state, surface))
        if to is None:
            to = state
            for char in surface:
                to = self._next(to, ord(char))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[state, surface] = to
        return to

    def longest(self, surfaces: Sequence[str | None]) -> tuple[list[int], list[str | None]]:
        """Per token the number of tokens of the longest phrase that begins
        there (0: none) and the phrase."""
        n: list[int] = [0] * len(surfaces)
        state, end, begins = 0, 0, {}
        for i, surface in enumerate(surfaces):
            if not surface:
                state, end, begins = 0, 0, {}
                continue
            begins[end] = i
            end += len(surface)
            state = self.step(state, surface)
            hit = state if self.length[state] else self.link[state]
            while hit:
                first = begins.get(end - self.length[hit])
                if first is not None:
                    n[first] = i + 1 - first
                hit = self.link[hit]
        return n, ["".join(surfaces[i:i + k]) if k else None for i, k in enumerate(n)]


# The automatons this worker has built, by list of phrases; those of the lists
# that are not ``_WANTED`` go when another list comes.
_BUILT: dict[str, PhraseAutomaton] = {}
_WANTED: list[tuple[str, ...]] = []


def phrase_steps(spark: SparkSession, classes: Sequence[Sequence[str]]) -> list:
    """Per class of phrases a function of a document's surfaces -> (n, phrase)
    of each token. The classes, PHRASE_CHARS characters at most each, are
    broadcast; each worker builds their automatons once and keeps them, as
    every document steps through all of them."""
    if any(sum(map(len, phrases)) > PHRASE_CHARS for phrases in classes):
        raise ValueError(f"more than {PHRASE_CHARS} characters of phrases in one automaton")
    names = tuple(hashlib.sha256("\0".join(c).encode("utf-8", "surrogatepass")).hexdigest() for c in classes)

    def steps_of(name: str, shared):
        def steps(surfaces: Sequence[str | None]) -> tuple[list[int], list[str | None]]:
            if name not in _BUILT:
                if _WANTED != [names]:
                    _BUILT.clear()
                    _WANTED[:] = [names]
                _BUILT[name] = PhraseAutomaton(shared.value)
            return _BUILT[name].longest(surfaces)
        return steps

    return [steps_of(name, spark.sparkContext.broadcast(list(c))) for name, c in zip(names, classes)]


def phrase_classes(phrases: Iterable[str], most: int | None = None) -> list[list[str]]:
    """The distinct phrases in classes of ``most`` characters at most (a
    longer phrase is a class of its own and is refused by ``phrase_hits``)."""
    most = PHRASE_CHARS if most is None else most
    classes: list[list[str]] = []
    room = 0
    for phrase in sorted({p for p in phrases if p}):
        if not classes or len(phrase) > room:
            classes.append([])
            room = most
        classes[-1].append(phrase)
        room -= len(phrase)
    return classes
