"""Phrase collocations by Toivonen mining, and their scores.

A sample of the documents proposes the frequent phrases, at a lowered count.
The full pass counts the proposed phrases and their negative border exactly:
every word; every pair of proposed words; every triple whose two pairs are
proposed. Where a member of the border turns out frequent, the border has
failed there: longer phrases that hold it were not counted. An expansion pass
then counts the phrases that the frequent ones allow and that no pass has
counted, until no failure is left. So the result is exact whatever the sample
holds; the sample only decides how much is left for the expansion.

What a pass may count is told to the tasks as bit tables of fixed size
(``WORD_BITS``, ``PAIR_BITS``), indexed by hashes of words and pairs. A
collision makes a pass count a phrase in vain and never hides one. Which pass
counts an occurrence follows from the tables of that pass and those before
it, so no occurrence is counted twice.

Tasks read their texts in chunks: words are found, numbered and counted with
arrays, so that a phrase leaves a chunk once with its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaudit.llm.text import table
from lexaudit.session import cut_lineage

MIN_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50
NO_LANGUAGE = "und"
# One document of so many is in the sample; what occurs there so often is proposed.
SAMPLE = 8
PROPOSED = 2
WORD_BITS = 24
PAIR_BITS = 26
CHUNK = 3 << 20
ROWS = 1 << 16
# Bytes of a text: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_COUNTS = "lang string, size int, phrase string, n long"


@dataclass(frozen=True)
class Pass:
    """Bit tables of the words whose pairs, and of the pairs whose triples a
    pass may count. ``later``: the pairs that the pass itself counts for the
    first time stand in for their table."""
    words: np.ndarray
    pairs: np.ndarray
    later: bool = False


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    start = f"{lang}\0".encode()
    return np.fromiter((xxhash.xxh64_intdigest(start + w.encode()) for w in words), np.uint64, len(words))


def _pair_hashes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    # Odd constants of a splitting generator.
    h = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def _held(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are set in a bit table; its size is read off the table."""
    slot = hashes >> np.uint64(64 - (len(marks) * 64).bit_length() + 1)
    return (marks[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _tally(data: bytes, lang: str, passes: list[Pass], with_words: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(size, phrases, counts) of the last pass on plain text."""
    raw = np.frombuffer(data, np.uint8)
    ends_piece = raw == 10
    gap = ends_piece | (raw == 32)
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[~gap])).dictionary_encode()
    names, ids = coded.dictionary, coded.indices.to_numpy()
    del raw, gap, offsets, edges, coded
    if with_words:
        yield 0, pa.array([""]), np.array([len(ids)])
        yield 1, names, np.bincount(ids, minlength=len(names))
    if not passes or len(ids) < 2:
        return
    piece = np.searchsorted(np.flatnonzero(ends_piece), starts)
    joined = piece[1:] == piece[:-1]
    del starts, ends, ends_piece, piece
    x, y = ids[:-1], ids[1:]
    hashes = _word_hashes(lang, names.to_pylist())
    pair_hashes = _pair_hashes(hashes[x], hashes[y])
    none = np.zeros(len(x), bool)
    pairs_before, triples_before, pairs, triples = none, none[1:], none, none[1:]
    for p in passes:
        pairs_before, triples_before = pairs_before | pairs, triples_before | triples
        held = _held(p.words, hashes)
        pairs = joined & held[x] & held[y] & ~pairs_before
        grows = joined & _held(p.pairs, pair_hashes)
        if p.later:
            grows |= pairs
        triples = grows[:-1] & grows[1:] & ~triples_before
    del pair_hashes, pairs_before, triples_before
    size = len(names)
    pair, n = np.unique(x[pairs].astype(np.int64) * size + y[pairs], return_counts=True)
    if len(pair):
        yield 2, pc.binary_join_element_wise(names.take(pa.array(pair // size)), names.take(pa.array(pair % size)), " "), n
    at = np.flatnonzero(triples)
    if len(at):
        pair, row = np.unique(ids[at].astype(np.int64) * size + ids[at + 1], return_inverse=True)
        triple, n = np.unique(row * size + ids[at + 2], return_counts=True)
        pair = pair[triple // size]
        yield 3, pc.binary_join_element_wise(*(names.take(pa.array(k)) for k in (pair // size, pair % size, triple % size)), " "), n


def _chunks(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of plain text of about ``size`` bytes, cut at ends of pieces; a
    longer piece stays whole."""
    at = 0
    while at < len(data):
        to = len(data)
        if to - at > size:
            to = data.rfind(b"\n", at, at + size) + 1 or data.find(b"\n", at + size) + 1 or to
        yield data[at:to]
        at = to


def _count(docs: DataFrame, passes: list, with_words: bool, least: int) -> DataFrame:
    """(lang, size, phrase, n) of the phrases of the last of the passes (one
    broadcast each) that occur ``least`` times or more; size 0 is the number
    of words of a language."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [p.value for p in passes]
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for part in _chunks(b"\n".join(waiting.pop(lang)).translate(_PLAIN), chunk):
                for size, phrases, n in _tally(part, lang, tables, with_words):
                    rows = pa.RecordBatch.from_arrays(
                        [pa.repeat(lang, len(n)), pa.repeat(pa.scalar(size, pa.int32()), len(n)), phrases,
                         pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])
                    for at in range(0, len(n), ROWS):
                        yield rows.slice(at, ROWS)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= chunk:
                    yield from flush(lang)
            while sum(sizes.values()) >= 2 * chunk:
                yield from flush(max(sizes, key=sizes.__getitem__))
        for lang in list(waiting):
            yield from flush(lang)

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(
        (F.col("size") == 0) | (F.col("n") >= least))


def _bit_table(phrases: DataFrame, size: int, bits: int) -> np.ndarray:
    """The bit table of the phrases of ``size`` words among (lang, size,
    phrase); at most 2^bits / 64 numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hash(lang, phrase) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            slot = np.unique(np.array(hashes, np.uint64) >> np.uint64(64 - bits))
            row, first = np.unique(slot >> np.uint64(6), return_index=True)
            if len(row):
                marks = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(marks.view(np.int64))], ["row", "marks"])

    found = (phrases.filter(F.col("size") == size).select("lang", "phrase").mapInArrow(run, "row long, marks long")
             .groupBy("row").agg(F.bit_or("marks").alias("marks")).toArrow())
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[found.column("row").to_numpy()] = found.column("marks").to_numpy().view(np.uint64)
    return out


def _hash(lang: str, phrase: str) -> int:
    hashes = _word_hashes(lang, phrase.split(" "))
    return int(hashes[0] if len(hashes) == 1 else _pair_hashes(hashes[:1], hashes[1:])[0])


def _failed(words: np.ndarray, pairs: np.ndarray, done: Pass) -> bool:
    """Whether a frequent word or pair is outside what the passes built on."""
    return bool(np.any(words & ~done.words) or np.any(pairs & ~done.pairs))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n): the phrases of one to three words that occur
    ``min_count`` times or more in their language, with exact counts, and
    under size 0 and the empty phrase the number of words of a language. Null
    and empty texts have no words; a null language is ``und``; repeated rows
    count each; ids only choose the sample and may be null; other columns are
    ignored. A text is held whole by one task, as is a piece without any end
    mark."""
    spark = docs.sparkSession
    texts = docs.filter(F.length(text_col) > 0).select(
        F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).cast("binary").alias("text"),
        F.col(id_col).alias("_id"))
    sample = texts.filter(F.pmod(F.xxhash64("_id", "text"), F.lit(SAMPLE)) == 0).select("lang", "text")
    texts = texts.select("lang", "text")

    def shared(p: Pass):
        return spark.sparkContext.broadcast(p)

    no_pairs = np.zeros((1 << PAIR_BITS) // 64, np.uint64)
    words = _bit_table(_count(sample, [], True, PROPOSED), 1, WORD_BITS)
    proposed = [shared(Pass(words, no_pairs))]
    pairs = _bit_table(_count(sample, proposed, False, PROPOSED), 2, PAIR_BITS)
    passes = [Pass(words, pairs)]
    sent = [shared(passes[0])]
    found = cut_lineage(_count(texts, sent, True, min_count))
    while True:
        words, pairs = _bit_table(found, 1, WORD_BITS), _bit_table(found, 2, PAIR_BITS)
        if not _failed(words, pairs, passes[-1]):
            return found
        passes.append(Pass(words | passes[-1].words, pairs | passes[-1].pairs, later=True))
        sent.append(shared(passes[-1]))
        more = cut_lineage(_count(texts, sent, False, min_count))
        found = found.union(more)
        # A pair that this pass has counted is one that it built on as well.
        own = _bit_table(more, 2, PAIR_BITS)
        passes[-1] = Pass(passes[-1].words, passes[-1].pairs | own, later=True)


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, **columns: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or
    three words of each language. a: its count; l, r: counts of the parts at
    the cut with the lowest score (then the first); score: 10^6 a^2 / (l r)
    rounded down, exact for counts below 10^16; n: words of the language. A
    phrase is left out where a longer one around it has at least half its
    count. Equal scores: larger count, then phrase by bytes. Edge cases as in
    ``frequent_phrases``; no phrase gives an empty table."""
    found = frequent_phrases(docs, min_count, **columns)
    words = F.split("phrase", " ", -1)
    phrases = found.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    cuts = phrases.select("lang", "phrase", "a", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.struct(F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"),
                           F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("right")))).alias("k", "cut"))
    part = found.filter("size > 0").select("lang", "phrase", "n")
    left = part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.select("lang", "phrase", "a", "k", "cut.left", "cut.right").join(left, ["lang", "left"]).join(right, ["lang", "right"])
    count = "decimal(19,0)"
    cuts = cuts.withColumn("score", F.expr(
        f"(cast(1000000 as decimal(7,0)) * (cast(a as {count}) * cast(a as {count}))) div (cast(l as {count}) * cast(r as {count}))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    around = (phrases.filter("size = 3")
              .select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * INSIDE_PERCENT))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = found.filter("size = 0").select("lang", "n")
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"),
        "n", F.col("best.score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all whole documents."""
    return collocations(table(spark, sf_dir, "documents"))
