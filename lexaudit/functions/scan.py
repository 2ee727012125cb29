"""The keyword scan (TOK4-TOK7) over the tokens of one document, in order.

``scan`` marks islands (maximal runs of tokens that may continue a compound),
where a compound may begin in them, and where the scan lands: on a forced
phrase, else a compound, else a single noun.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexaudit.functions.batches import by_slices

# Bits of a token's part of speech.
EXT, START, SINGLE = 1, 2, 4
# Bits of a normalised surface: all numbers, all signs, all hiragana.
NUMBERS, SIGNS, HIRAGANA = 1, 2, 4
MEMO = 1 << 17
_WS_RUN = re.compile(r"\s+")
_HIRAGANA = re.compile("[ぁ-んー]+")


def normalized(token: str) -> str:
    """TOK2 of one token."""
    s = (token if token.isascii() else unicodedata.normalize("NFKC", token)).strip()
    return (s if s.isalnum() else _WS_RUN.sub("", s)).lower()


def _marks(ns: str) -> int:
    if ns.isalpha() and ns.isascii() or not ns:
        return 0
    kinds = {unicodedata.category(c)[0] for c in ns}
    return NUMBERS * (kinds == {"N"}) | SIGNS * (kinds <= {"P", "S"}) | HIRAGANA * bool(_HIRAGANA.fullmatch(ns))


class _Words(dict):
    """Surface -> (normalised surface, its marks), kept for the words met last."""

    def __missing__(self, token: str) -> tuple[str, int]:
        if len(self) >= MEMO:
            self.clear()
        ns = normalized(token)
        self[token] = got = (ns, _marks(ns))
        return got


_words = _Words()


def _landings(pos: Sequence[int], nxt: list[int], forced: Sequence[int], comp: list[int]) -> list[bool]:
    """Where the scan lands. A position that no take from before reaches past
    is a sure landing; such points cut a document into segments. A segment
    with a forced phrase is walked, in another one the scan lands up to its
    first compound."""
    n, land, i = len(pos), [True] * len(pos), 0
    while i < n:
        reach, j = nxt[i], i + 1
        while j < n and reach > pos[j]:
            reach = max(reach, nxt[j])
            j += 1
        if j - i > 1:
            if any(forced[i:j]):
                cur, picks = pos[i], set()
                for k in sorted(range(i, j), key=lambda k: (pos[k], nxt[k])):
                    if pos[k] == cur:
                        picks.add(cur)
                        cur = nxt[k]
                land[i:j] = [p in picks for p in pos[i:j]]
            else:
                first = min((pos[k] for k in range(i, j) if comp[k]), default=None)
                land[i:j] = [first is None or p <= first for p in pos[i:j]]
        i = j
    return land


def scan(pos: Sequence[int], surface: Sequence[str], base: Sequence[str], flags: Sequence[int],
         longest: Callable[[list[str]], tuple[list[int], list[str | None]]] | None,
         compound_mode: bool) -> tuple[list[int], list[str], list[str]]:
    """(positions, keywords, kinds) of a document's tokens in order; ``base``
    is empty where it is the surface. ``longest``: the forced phrases that
    begin at each token, if there are any."""
    n = len(pos)
    words = [_words[s] for s in surface]
    ns = [w[0] for w in words]
    ext = [bool(f & EXT and s) for f, s in zip(flags, ns)]
    # Of an island: its end where a compound may begin (else 0), and where the
    # first compound begins.
    comp, starts, islands, i = [0] * n, [None] * n, [], 0
    while i < n:
        if not ext[i]:
            i += 1
            continue
        j = i + 1
        while j < n and ext[j]:
            j += 1
        if compound_mode and j - i > 1:
            marks, size, first = words[j - 1][1], len(ns[j - 1]), None
            for k in range(j - 2, i - 1, -1):
                marks &= words[k][1]
                size += len(ns[k])
                if flags[k] & START and not (marks & (NUMBERS | SIGNS) or marks & HIRAGANA and size <= 2):
                    comp[k], first = pos[j - 1] + 1, pos[k]
            if first is not None:
                islands.append((i, j, first))
        i = j
    if longest is None:
        forced, phrases, land = (), (), None
        for i, j, first in islands:
            starts[i:j] = [first] * (j - i)
    else:
        forced, phrases = longest(ns)
        land = _landings(pos, [p + f if f else c or p + 1 for p, f, c in zip(pos, forced, comp)], forced, comp)
        for i, j, _ in islands:
            taken = [pos[k] for k in range(i, j) if comp[k] and land[k] and not forced[k]]
            if taken:
                starts[i:j] = [max(taken)] * (j - i)
    at: list[int] = []
    keywords: list[str] = []
    kinds: list[str] = []
    k = 0
    while k < n:
        p = pos[k]
        if starts[k] is not None and p >= starts[k]:
            # The compound: the rest of the island, which begins here.
            end = k + 1
            while end < n and ext[end]:
                end += 1
            at.append(p)
            keywords.append("".join(ns[k:end]))
            kinds.append("compound")
            k = end
            continue
        if land is None or land[k]:
            value, kind = None, "single"
            if forced and forced[k]:
                value, kind = phrases[k], "forced"
            elif flags[k] & SINGLE:
                value = (_words[base[k]][0] if base[k] else "") or ns[k]
            # A place that comes twice gives one keyword.
            if value:
                if at and at[-1] == p:
                    if (kind, value) < (kinds[-1], keywords[-1]):
                        keywords[-1], kinds[-1] = value, kind
                else:
                    at.append(p)
                    keywords.append(value)
                    kinds.append(kind)
        k += 1
    return at, keywords, kinds


def phrases_at(pos: Sequence[int], surface: Sequence[str],
               longest: Callable[[list[str]], tuple[list[int], list[str | None]]]) -> tuple[list[int], list[str], list[int]]:
    """(positions, phrases, tokens) of the longest phrases in a document."""
    n, text = longest([_words[s][0] for s in surface])
    hits = [i for i, k in enumerate(n) if k]
    return [pos[i] for i in hits], [text[i] for i in hits], [n[i] for i in hits]


KEYWORDS = pa.struct([("pos", pa.list_(pa.int32())), ("keyword", pa.list_(pa.string())), ("kind", pa.list_(pa.string()))])
KEYWORDS_DDL = "pos array<int>, keyword array<string>, kind array<string>"
PHRASES = pa.struct([("pos", pa.list_(pa.int32())), ("phrase", pa.list_(pa.string())), ("n_tokens", pa.list_(pa.int32()))])
PHRASES_DDL = "pos array<int>, phrase array<string>, n_tokens array<int>"


def _ordered(columns: list[list]) -> list[Sequence]:
    """The lists of one document in the order of the first."""
    pos = columns[0]
    if all(a < b for a, b in zip(pos, pos[1:])):
        return columns
    return list(zip(*sorted(zip(*columns))))


def document_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch by runs of the same first column: one row per
    run, the other columns as lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        a, b = key.slice(0, len(key) - 1), key.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        begins = np.flatnonzero(np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)]))
        ends = pa.array(np.append(begins, len(key)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [key.take(pa.array(begins)), *(pa.ListArray.from_arrays(ends, c) for c in batch.columns[1:])],
            batch.schema.names)


def _flat(lists: pa.ListArray) -> tuple[list, list[int]]:
    """All values of a column of lists, and where each list begins and ends."""
    first = lists.offsets[0].as_py()
    return lists.flatten().to_numpy(zero_copy_only=False).tolist(), [at - first for at in lists.offsets.to_pylist()]


def per_document(one: Callable[..., tuple], to: pa.StructType) -> Callable[..., pa.Array]:
    """``one`` of the lists of a document as a function of columns of lists
    (without nulls)."""
    def convert(*columns: pa.Array) -> pa.Array:
        flat = [_flat(c) for c in columns]
        out: list[list] = [[] for _ in to]
        ends = [0]
        for i in range(len(columns[0])):
            found = one(*_ordered([values[at[i]:at[i + 1]] for values, at in flat]))
            for all_, new in zip(out, found):
                all_.extend(new)
            ends.append(len(out[0]))
        parts = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, f.type.value_type))
                 for values, f in zip(out, to)]
        return pa.StructArray.from_arrays(parts, fields=list(to))
    return by_slices(convert, to)


def normalize_lists(lists: pa.Array) -> pa.Array:
    """TOK2 of each token of each row."""
    flat, at = _flat(lists)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([_words[t][0] for t in flat], pa.string()))
