"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of the lower-cased words with one space between and an
end symbol. The tree's contexts are the up to ``DEPTH`` bytes before a symbol,
across words. A context is a candidate if at least ``MIN_COUNT`` symbols follow
it, a fixed number, so a larger corpus teaches rarer contexts, and is kept if
its next-symbol counts diverge from those of the context that is one byte
shorter: log likelihood ratio of ``DIVERGENCE`` nats or more for each of its
symbols (chance alone gives about half a nat).
Next-symbol distributions are smoothed with that of the next shorter kept
context. A symbol is scored in the longest kept context that its past ends
with.

The tree is never in one place:

1. A chunk of texts (a stretch of the scan) sends its distinct grams (context and symbol), each with
   its count in the training texts, to the hash part of the gram.
2. A part adds up the counts of its grams and sends them to the branch of
   their nearest ``SHORT + 1`` bytes.
3. A branch holds all grams of its contexts of that length and longer; it adds
   up the counts of these contexts, tests them, and finds the probability of
   each gram. Contexts of at most ``SHORT`` bytes have at most 2^24 entries
   whatever the corpus; they alone are collected and broadcast.
4. A part sends the probabilities back to the chunks, which add them up per
   text.

The word-unigram base goes the same way beside it: a chunk sends its distinct
words with their counts in the training texts to the hash part of the word, a
part adds them up and sends the sums back in the order in which the words came,
and the chunk adds up the logarithms per text. No vocabulary is ever broadcast.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.packing import pack, pack_bytes, unpack, unpack_bytes
from lexaudit.llm.text import blocks_of, id_remainder
from lexaudit.session import cut_lineage, written

DEPTH = 6
SHORT = 2                 # longest contexts that are broadcast
MIN_COUNT = 2
DIVERGENCE = 1.0
BETA = 16.0
CHUNK_BYTES = 1 << 20     # of text that a task holds as arrays
STRETCH_BYTES = 14 << 20  # of text whose distinct grams are sent together
PART_BYTES = 16 << 20     # of text whose distinct grams are one part
WORD_PART_BYTES = 32 << 20  # of text whose distinct words are one part
POSTING_BYTES = 16 << 20
_END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(first columns, words) of rows whose last column is the text, with about
    ``most`` bytes of text at a time; a longer text is a chunk of its own."""
    keys: list = []
    found: list[list[bytes]] = []
    size = 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for i, text in enumerate(batch.column(batch.num_columns - 1)):
            text = text.as_py()
            n = len(text or "")
            if found and size + n > most:
                yield keys, found
                keys, found, size = [], [], 0
            keys.append([c[i] for c in columns])
            found.append(tokens(text))
            size += n
    if found:
        yield keys, found


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each symbol, number of symbols of each text). A gram has the
    byte before in its highest place, then the one before that, and so on, and
    the symbol in its lowest. Spaces stand before a text."""
    streams = [b" " * DEPTH + b" ".join(ws) + _END for ws in texts]
    sizes = np.fromiter(map(len, streams), np.int64, len(streams)) - DEPTH
    data = np.frombuffer(b"".join(streams), np.uint8).astype(np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(streams) + 1) * DEPTH, sizes)
    keys = data[at]
    for back in range(1, DEPTH + 1):
        keys |= data[at - back] << (8 * (DEPTH + 1 - back))
    return keys, sizes


class Tree:
    """Kept contexts by depth with their smoothed distributions, as sorted
    arrays. ``levels[d]`` is (contexts, their totals, entry keys, entry
    counts); an entry key is the context's place << 8 | symbol."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for d, (contexts, totals, entries, counts) in enumerate(levels):
            place, symbol = entries >> 8, entries & 255
            as_gram = contexts[place] << (8 * (DEPTH + 1 - d)) | symbol if len(entries) else entries
            shorter = 10 ** self.log10(as_gram, d - 1)
            prob = (counts + BETA * shorter) / (totals[place] + BETA)
            self.levels.append((contexts, np.log10(BETA / (totals + BETA)), entries, np.log10(prob)))

    def log10(self, keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for d in range(min(depth, len(self.levels) - 1), -1, -1):
            contexts, back, entries, prob = self.levels[d]
            if not len(contexts) or not len(left):
                continue
            wanted = keys[left] >> (8 * (DEPTH + 1 - d))
            place = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
            known = contexts[place] == wanted
            some, place = left[known], place[known]
            wanted = place << 8 | keys[some] & 255
            entry = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            seen = entries[entry] == wanted
            out[some[seen]] += prob[entry[seen]]
            out[some[~seen]] += back[place[~seen]]
            left = np.concatenate([left[~known], some[~seen]])
        out[left] -= math.log10(256)
        return out


def shorten(entries: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, counts) of the contexts one byte shorter, and the place there
    of each entry. An entry is context << 8 | symbol."""
    up, place = np.unique(entries >> 16 << 8 | entries & 255, return_inverse=True)
    return up, np.bincount(place, counts, len(up)), place


class Level:
    """The entries of one depth (sorted, with counts, which may be 0): ``share``
    of the context's symbols, whether the context is kept, and ``prob``.
    ``share`` and ``prob`` of the next shorter contexts are given per entry."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray, shorter_share: np.ndarray | None, shorter_prob: np.ndarray | float,
                 min_count: int, divergence: float):
        first = np.flatnonzero(np.append(True, entries[1:] >> 8 != entries[:-1] >> 8)[:len(entries)])
        sizes = np.diff(np.append(first, len(entries)))
        each = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
        self.total = np.repeat(each, sizes)
        self.share = counts / np.maximum(self.total, 1)
        if shorter_share is None:
            self.kept = np.ones(len(entries), bool)
        else:
            seen = counts > 0
            gain = np.zeros(len(entries))
            gain[seen] = counts[seen] * np.log(self.share[seen] / shorter_share[seen])
            symbols = np.repeat(np.arange(len(first)), sizes)
            enough = np.bincount(symbols, gain, len(first)) >= divergence * np.bincount(symbols, seen, len(first))
            self.kept = np.repeat((each >= min_count) & enough, sizes)
        self.prob = np.where(self.kept, (counts + BETA * shorter_prob) / (self.total + BETA), shorter_prob)


def levels(entries: np.ndarray, counts: np.ndarray, longest: int, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE,
           short: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray, Level]]:
    """(entries, counts, level) for each depth up to ``longest``, of which
    sorted ``entries`` are; from 0, or from the depth after that of ``short``
    (entries, share, prob)."""
    shortest = 0 if short is None else SHORT + 1
    down = [(entries, counts.astype(np.float64), None)]
    for _ in range(longest - shortest):
        up, n, place = shorten(*down[-1][:2])
        down[-1] = (*down[-1][:2], place)
        down.append((up, n, None))
    out: list[tuple[np.ndarray, np.ndarray, Level]] = []
    for mine, n, place in reversed(down):
        if out:
            level = Level(mine, n, out[-1][2].share[place], out[-1][2].prob[place], min_count, divergence)
        elif short is None:
            level = Level(mine, n, None, 1 / 256, min_count, divergence)
        else:
            place = np.searchsorted(short[0], mine >> 16 << 8 | mine & 255)
            level = Level(mine, n, short[1][place], short[2][place], min_count, divergence)
        out.append((mine, n, level))
    return out


def learn(docs: DataFrame, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE) -> Tree:
    """The suffix tree of ``docs`` (text) in memory, for small corpora;
    ``all_scores`` scores by the same tree without collecting it."""
    texts = [tokens(r.text) for r in docs.select("text").collect()]
    keys, n = np.unique(grams(texts)[0], return_counts=True) if texts else (np.zeros(0, np.int64),) * 2
    found = []
    for entries, counts, level in levels(keys, n, DEPTH, min_count, divergence):
        entries, counts, total = entries[level.kept], counts[level.kept], level.total[level.kept]
        contexts, first, place = np.unique(entries >> 8, return_index=True, return_inverse=True)
        found.append((contexts, total[first], place.astype(np.int64) << 8 | entries & 255, counts))
    return Tree(found)


def unpack_all(column: pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([unpack(x, kind) for x in column.to_pylist()])


def hashed(values: np.ndarray, groups: int) -> np.ndarray:
    """The group of each value."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def dealt(values: np.ndarray, groups: int) -> list[tuple[int, np.ndarray]]:
    """(group, places of its values in their order), by ascending group."""
    group = hashed(values, groups)
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)[:len(order)])
    return [(int(group[at[0]]), at) for at in np.split(order, edges[1:])] if len(order) else []


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns)})


def numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, ..., text) with their chunk: the first row of a stretch of
    about ``most`` bytes of text. Depends on the order of the rows alone."""
    first, size = None, 0
    for batch in batches:
        out = []
        for row, n in zip(batch.column("row").to_pylist(), pc.binary_length(batch.column("text")).to_pylist()):
            if first is None or size and size + (n or 0) > most:
                first, size = row, 0
            out.append(first)
            size += n or 0
        yield batch.append_column("chunk", pa.array(out, pa.int64()))


def uniques(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; by a sort, as np.unique's hash table takes
    several times as long for millions of values."""
    some = np.sort(values)
    return some[np.append(True, some[1:] != some[:-1])[:len(some)]]


def distinct(marks: list[bool], texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts in the marked texts."""
    taught, held = ([t for t, m in zip(texts, marks) if bool(m) == x] for x in (True, False))
    keys, n = np.unique(grams(taught)[0], return_counts=True) if taught else (np.zeros(0, np.int64),) * 2
    if not held:
        return keys, n
    other = uniques(grams(held)[0])
    return merged([keys, other], [n, np.zeros(len(other), np.int64)])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    some = np.concatenate(keys)
    if not len(some):
        return some, np.zeros(0, np.int64)
    # Stable: sorted runs are merged rather than sorted again.
    order = np.argsort(some, kind="stable")
    some = some[order]
    n = np.concatenate(counts)[order]
    del order
    first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
    return some[first], np.add.reduceat(n, first)


class Sums:
    """Counts of keys that come in sorted pieces. Pieces of about one size are
    merged as they come, so a key is held a few times at most."""

    def __init__(self) -> None:
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pieces.append((keys, counts))
        while len(self.pieces) > 1 and len(self.pieces[-2][0]) < 2 * len(self.pieces[-1][0]):
            self._merge_last()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.pieces) > 1:
            self._merge_last()
        return self.pieces.pop() if self.pieces else (np.zeros(0, np.int64),) * 2

    def _merge_last(self) -> None:
        one, other = self.pieces.pop(), self.pieces.pop()
        self.pieces.append(merged([other[0], one[0]], [other[1], one[1]]))


def dealt_words(words: Iterable[bytes], groups: int) -> list[tuple[int, list[bytes]]]:
    """(group, its words in byte order), by ascending group."""
    names = sorted(words)
    group = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(groups + 1, dtype=np.uint64)).tolist()
    return [(g, [names[i] for i in order[a:b].tolist()]) for g, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def pack_words(words: list[bytes]) -> bytes:
    return pack_bytes(b"\n".join(words) + b"\n")


def unpack_words(raw: bytes) -> pa.Array:
    """The words of a message, each with the line feed behind it."""
    data = unpack_bytes(raw)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == ord("\n")) + 1
    offsets = np.append(0, ends).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def count_words(table: pa.Table) -> pa.Table:
    """The messages of one part of the words (part, chunk, grams, data), each
    with the sums of its words over all of them, in its order; n and v are the
    occurrences and the distinct words in training texts, told once."""
    sent = [unpack_words(x) for x in table.column("grams").to_pylist()]
    ends = np.cumsum([len(x) for x in sent])
    words = pa.concat_arrays(sent).dictionary_encode()
    place = words.indices.to_numpy()
    sums = np.zeros(len(words.dictionary), np.int64)
    np.add.at(sums, place, unpack_all(table.column("data")))
    once = np.arange(len(sent)) == 0
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"),
                     "data": pa.array([pack(sums[x]) for x in np.split(place, ends[:-1])], pa.binary()),
                     "n": pa.array(once * sums.sum()), "v": pa.array(once * (sums > 0).sum())})


def all_scores(rows: DataFrame, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE) -> tuple[DataFrame, int, int]:
    """((row, doc_id, learn, n_tokens, known, logs, score), N, V): per text the
    occurrences of words seen in the texts to learn from, the sum of
    log10(c + 0.5) over its words, and its log10 probability by the tree; words
    and distinct words of the texts to learn from, ends not counted."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    parts, most = blocks_of(size, PART_BYTES), STRETCH_BYTES
    word_parts = blocks_of(size, WORD_PART_BYTES)
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunked = rows.select("row", "doc_id", "learn", "text").mapInArrow(
        lambda batches: numbered(batches, most), f"row long, doc_id {kind}, learn boolean, text string, chunk long")
    packed = {"grams": pa.binary(), "data": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def message() -> Iterator[pa.RecordBatch]:
            keys, n = found.take()
            rows = [(g, chunk, pack(keys[at]), pack(n[at])) for g, at in dealt(keys, parts)]
            # The parts of words are numbered behind those of grams.
            rows += [(parts + g, chunk, pack_words(ws), pack(np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))))
                     for g, ws in dealt_words(seen, word_parts)]
            seen.clear()
            yield from _table({"part": pa.int32(), "chunk": pa.int64(), **packed}, rows).to_batches()

        chunk, found = None, Sums()
        seen: dict[bytes, int] = {}
        for marks, texts in chunks(batches, CHUNK_BYTES):
            edges = [i for i in range(len(marks)) if not i or marks[i][0] != marks[i - 1][0]]
            for a, b in zip(edges, [*edges[1:], len(marks)]):
                if found.pieces and marks[a][0] != chunk:
                    yield from message()
                chunk = marks[a][0]
                found.add(*distinct([m[1] for m in marks[a:b]], texts[a:b]))
                for w, n in Counter(chain.from_iterable(t for m, t in zip(marks[a:b], texts[a:b]) if m[1])).items():
                    seen[w] = seen.get(w, 0) + n
                for w in set(chain.from_iterable(t for m, t in zip(marks[a:b], texts[a:b]) if not m[1])):
                    seen.setdefault(w, 0)
        if found.pieces:
            yield from message()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        sums = Sums()
        for gram, count in zip(table.column("grams").to_pylist(), table.column("data").to_pylist()):
            sums.add(unpack(gram), unpack(count))
        keys, n = sums.take()
        return _table({"branch": pa.int32(), "part": pa.int32(), **packed},
                      [(g, key[0].as_py(), pack(keys[at]), pack(n[at])) for g, at in dealt(keys >> 8 * (DEPTH - SHORT), parts)])

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries, n = unpack(raw), unpack(told)
                for _ in range(DEPTH - SHORT):
                    entries, n, _ = shorten(entries, n)
                yield from parts_of([pa.array(entries), pa.array(n.astype(np.int64))], ["entry", "n"])

    # Numbered as in chunked, by the worker that sends: a worker more in each
    # task would hold memory beside it.
    # Kept by part: it is read three times by it, each time without an exchange.
    kept = written(rows.select("row", "learn", "text").mapInArrow(
        lambda batches: send(b.select(["chunk", "learn", "text"]) for b in numbered(batches, most)), "part int, chunk long, grams binary, data binary"), "part")
    sent = kept.filter(F.col("part") < parts)
    counted = cut_lineage(kept.filter(F.col("part") >= parts).groupBy("part").applyInArrow(
        count_words, "chunk long, part int, data binary, n long, v long"))
    sums = counted.agg(F.sum("n"), F.sum("v")).first()
    added = cut_lineage(sent.groupBy("part").applyInArrow(add, "branch int, part int, grams binary, data binary"))
    # At most 2^24 entries, as the alphabet is of bytes.
    found = added.select("grams", "data").mapInArrow(shortened, "entry long, n long").groupBy("entry").agg(
        F.sum("n").alias("n")).toPandas().sort_values("entry")
    entries = found.entry.to_numpy(np.int64)
    told = levels(entries, found.n.to_numpy(np.int64), SHORT, min_count, divergence)[-1][2]
    short = rows.sparkSession.sparkContext.broadcast((entries, told.share, told.prob))

    def branch(table: pa.Table) -> pa.Table:
        got = [unpack(x) for x in table.column("grams").to_pylist()]
        n = unpack_all(table.column("data"))
        keys = np.concatenate(got)
        order = np.argsort(keys)
        prob = np.empty(len(keys))
        prob[order] = levels(keys[order], n[order], DEPTH, min_count, divergence, short.value)[-1][2].prob
        ends = np.cumsum([len(x) for x in got])[:-1]
        return _table({"part": pa.int32(), **packed},
                      [(p, pack(k), pack(x)) for p, k, x in
                       zip(table.column("part").to_pylist(), got, np.split(np.log10(prob), ends))])

    def answer(table: pa.Table, told: pa.Table) -> pa.Table:
        keys, logs = unpack_all(told.column("grams")), unpack_all(told.column("data"), np.float64)
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        return _table({"chunk": pa.int64(), "part": pa.int32(), "data": pa.binary()},
                      [(c, p, pack(logs[np.searchsorted(keys, unpack(x))])) for c, p, x in
                       zip(*(table.column(n).to_pylist() for n in ("chunk", "part", "grams")))])

    def total(table: pa.Table, told: pa.Table) -> pa.Table:
        n_tokens, found, ids = [], [], []
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        for _, texts in chunks(iter(table.select(["text"]).combine_chunks().to_batches()), CHUNK_BYTES):
            each, sizes = grams(texts)
            some, where = np.unique(each, return_inverse=True)
            found.append((some, where.astype(np.int32), sizes))
            n = list(map(len, texts))
            n_tokens += n
            ids.append(np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int32, sum(n)))
        answers = dict(zip(told.column("part").to_pylist(), told.column("data").to_pylist()))
        c = np.zeros(len(number), np.int64)
        for g, ws in dealt_words(number, word_parts):
            c[np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))] = unpack(answers.pop(parts + g))
        number.clear()
        text, word = np.repeat(np.arange(len(n_tokens)), n_tokens), np.concatenate(ids)
        known = np.bincount(text, c[word] > 0, len(n_tokens)).astype(np.int64)
        base = np.bincount(text, np.log10(c + 0.5)[word], len(n_tokens))
        del text, word, ids
        keys = uniques(np.concatenate([f[0] for f in found]))
        logs = np.empty(len(keys))
        for g, at in dealt(keys, parts):
            logs[at] = unpack(answers[g], np.float64)
        scores = [np.add.reduceat(logs[np.searchsorted(keys, some)][where], np.cumsum(sizes) - sizes) for some, where, sizes in found]
        out = table.select(["row", "doc_id", "learn"])
        for name, values in (("n_tokens", np.array(n_tokens, np.int64) + 1), ("known", known), ("logs", base.astype(np.float64)),
                             ("score", np.concatenate(scores))):
            out = out.append_column(name, pa.array(values))
        return out

    scored = added.groupBy("branch").applyInArrow(branch, "part int, grams binary, data binary")
    answers = sent.groupBy("part").cogroup(scored.groupBy("part")).applyInArrow(
        answer, "chunk long, part int, data binary").union(counted.select("chunk", "part", "data"))
    out = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        total, f"row long, doc_id {kind}, learn boolean, n_tokens long, known long, logs double, score double")
    return out, int(sums[0] or 0), int(sums[1] or 0)


def parts_of(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def met_words(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Postings of rows (key, text) from stretches of about ``most`` bytes of
    text. Words are objects for ``CHUNK_BYTES`` at a time and numbers after."""
    def message() -> Iterator[pa.RecordBatch]:
        first = min(int(k.min()) for k in held_keys)
        word, at, n = (np.concatenate(x) for x in (held_words, [k - first for k in held_keys], held_n))
        order = np.argsort(word, kind="stable")
        values = np.empty(2 * len(word), np.int32)
        values[::2], values[1::2] = at[order], n[order]
        starts = 2 * np.searchsorted(word[order], np.arange(len(number) + 1))
        yield from parts_of([pa.array(number.keys(), pa.binary()), pa.array(np.full(len(number), first)),
                             pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))], ["word", "first", "at"])

    number: dict[bytes, int] = {}
    held_words, held_keys, held_n, size = [], [], [], 0
    for rows, texts in chunks(batches, min(most, CHUNK_BYTES)):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in texts for w in ws), np.int64, int(sizes.sum()))
        both, n = np.unique(ids * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
        if len(both):
            held_words.append((both // len(texts)).astype(np.int32))
            held_keys.append(np.array([r[0] for r in rows], np.int64)[both % len(texts)])
            held_n.append(n.astype(np.int32))
        size += sum(len(w) + 1 for ws in texts for w in ws)
        if number and size >= most:
            yield from message()
            number, size = {}, 0
            held_words, held_keys, held_n = [], [], []
    if number:
        yield from message()


def postings(docs: DataFrame, key: str = "row") -> DataFrame:
    """(word, first, at): ``at`` holds key and occurrences of the texts that
    have the word, from one stretch of the input, as pairs in one array; the
    keys of one partition are less than 2^31 apart and are told from ``first``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from met_words(batches, POSTING_BYTES)

    return docs.select(key, "text").mapInArrow(run, "word binary, first long, at array<int>")


def score_documents(docs: DataFrame, training: Callable[[], "F.Column"], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, is_training, n_tokens, n_known, train_tokens, base_score,
    score), one row per input row; ``training`` gives the condition on doc_id
    that tells the rows to learn from (null counts as true).

    Null and empty texts are the end symbol alone. Repeated rows count and are
    scored each; other columns are ignored. With nothing to learn from, the
    base is uniform over one unknown token and the tree over the bytes. Rows
    are told apart by their place in the scan, so ``docs`` should be a table or
    a checkpoint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()).withColumn("learn", F.coalesce(training(), F.lit(True)))
    n_taught = rows.filter("learn").count()
    told, n_words, n_distinct = all_scores(rows)
    n, v = n_words + n_taught, n_distinct + (n_taught > 0)
    each = F.lit(math.log10(n + 0.5 * (v + 1)))
    return told.select(
        "doc_id", F.col("learn").alias("is_training"), "n_tokens",
        (F.col("known") + int(n_taught > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(n_taught + 0.5) - F.col("n_tokens") * each).alias("base_score"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and suffix-tree scores of all documents."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda: id_remainder() != 1)
    return out.select("doc_id", (~F.col("is_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")
