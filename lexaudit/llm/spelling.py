"""Spelling variants: words at edit distance one, grouped under their most
frequent form, by pivotal grams.

Bigrams have one order for all words, rare ones first. The *prefix* of a word
are its three first bigrams in that order (and all that tie with the third);
its two *pivots* are the disjoint bigrams of the prefix with the least total
frequency, found by dynamic programming over positions. One edit destroys one
of two disjoint bigrams at most, so of two near words the one whose third
bigram comes first in the order has a pivot that the other one has in its
prefix. Positions limit the search: one edit lies on one side of the pivot
that survives, so the words agree up to that bigram or from it on, and their
lengths differ by one at most. A join key is therefore (side, length of the
partner, agreeing part of the word) as a 64-bit hash, and the join verifies
the edit distance on the words, so collisions have no effect.

Only counts of bigrams by hash bucket (``BUCKETS`` numbers, whatever the
alphabet) are sent to the tasks; any order common to all words gives the same
pairs, frequencies only make the keys rare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.text import table
from lexaudit.session import cut_lineage

RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
DELETED = 97
BUCKETS = 1 << 16
PREFIX = 3


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word), one row per letter run of at least ``MIN_LENGTH`` code points
    of every whole text, with A-Z in lower case. Where 97 divides the CRC-32
    of '<id>:<run>' one code point of the run is left out. Null and empty
    texts have no runs; a null id is written as the empty string; repeated
    rows count each; other columns are ignored."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                      F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("_run"))
    size = F.char_length("_run")
    # A shorter run gives no word with or without a deletion.
    run = run.filter(size >= MIN_LENGTH).select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % size).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, size))
    return run.select(F.when(F.col("_h") % DELETED == 0, cut).otherwise(F.col("_run")).alias("word")).filter(
        F.char_length("word") >= MIN_LENGTH)


def word_counts(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def bucket_counts(words: DataFrame) -> np.ndarray:
    """Number of bigrams of the distinct words by hash bucket."""
    gram = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    rows = (words.select(F.explode(gram).alias("gram"))
            .groupBy((F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int").alias("bucket")).count().collect())
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["count"]
    return counts


def prefix_of(word: str, counts: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """((position, order number) of the prefix bigrams by position, order
    number of the third bigram)."""
    grams = []
    for p in range(len(word) - 1):
        code = zlib.crc32(word[p:p + 2].encode())
        grams.append((p, int(counts[code % BUCKETS]) << 32 | code))
    last = sorted(g[1] for g in grams)[PREFIX - 1]
    return [g for g in grams if g[1] <= last], last


def pivots_of(prefix: list[tuple[int, int]]) -> list[int]:
    """Positions of the two disjoint bigrams with the least total frequency.
    ``lightest`` is the best single bigram that ends before the current one."""
    best = lightest = None
    free = 0
    for p, order in prefix:
        while prefix[free][0] <= p - 2:
            if lightest is None or prefix[free][1] < lightest[1]:
                lightest = prefix[free]
            free += 1
        if lightest is not None:
            total = (lightest[1] >> 32) + (order >> 32)
            if best is None or total < best[0]:
                best = total, lightest[0], p
    return [best[1], best[2]]


def _key(side: str, length: int, part: str) -> int:
    return xxhash.xxh64_intdigest(f"{side}{length}:{part}".encode()) - (1 << 63)


def _keys(words: DataFrame, shared, pivots: bool) -> DataFrame:
    """(key, word, n, last): the keys under which a word looks for partners
    with its pivots, or those under which its prefix is found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, rows, lasts = [], [], []
                for row, word in enumerate(part.column(0).to_pylist()):
                    prefix, last = prefix_of(word, counts)
                    size = len(word)
                    places = pivots_of(prefix) if pivots else [p for p, _ in prefix]
                    before = len(keys)
                    for length in (size - 1, size, size + 1) if pivots else (size,):
                        for p in places:
                            keys.append(_key("f", length, word[:p + 2]))
                            keys.append(_key("b", length, word[p:]))
                    rows += [row] * (len(keys) - before)
                    lasts += [last] * (len(keys) - before)
                picked = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), picked.column(0), picked.column(1), pa.array(lasts, pa.int64())],
                    ["key", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, last long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways round, once for every two words that
    differ by exactly one inserted, deleted or replaced code point. ``words``:
    (word, n), distinct, of four code points or more each; best a written or
    checkpointed table, since it is read three times."""
    shared = words.sparkSession.sparkContext.broadcast(bucket_counts(words))
    a, b = _keys(words, shared, True).alias("a"), _keys(words, shared, False).alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last"))
                 & (F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    pair = met.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("a.n").alias("_n"),
                      F.col("b.n").alias("near_n"))
    both = pair.select(F.explode(F.array(
        F.struct("word", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("_n").alias("near_n")))).alias("p"))
    return both.select("p.*").repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms. Pointers
    are doubled; a form is at least twice as frequent as its word, so chains
    are short (at most the binary logarithm of the largest count)."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"),
            F.col("b.word").isNotNull().alias("moved"))
        step = cut_lineage(step)
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n). form: the
    most frequent near word (ties: the first by code points) if it is at least
    twice as frequent, else null; root: the last word when forms are followed,
    the word itself without any. An empty table gives an empty table."""
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    linked = words.join(best, "word", "left")
    holds = -F.col("best.less") >= 2 * F.col("n")
    linked = cut_lineage(linked.select(
        "word", F.when(holds, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(holds, -F.col("best.less")).alias("form_n")))
    ends = roots(linked.filter(F.col("form").isNotNull()))
    return linked.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all whole documents."""
    return variants(word_counts(runs(table(spark, sf_dir, "documents"))))
