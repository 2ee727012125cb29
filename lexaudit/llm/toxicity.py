"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5, with word
boundaries) and of itself, all hashed into ``BUCKETS`` rows; a document is the
mean of its distinct words (a word repeated a thousand times counts once); a softmax over two classes reads that mean. Embeddings and
softmax are trained together in numpy (Adam on batches), so an unseen
misspelling is scored by the n-grams it shares.

The model is fitted on a bounded sample: ``MAX_ROWS`` labelled rows (half of
them of each class as far as there are, the smallest hashes of their ids) of
``MAX_BYTES`` bytes of text at most, weighted back to the class sizes of all
learning rows. That is all the driver gets. Everything is scored, over whole
texts, in one pass without a shuffle: after training, a word's share in the
logit is one number, kept in a bounded cache.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.kept import kept
from lexaudit.llm.text import id_remainder

MAX_ROWS = 4000
MAX_BYTES = 32_768
BUCKETS = 1 << 17
DIM = 4
EPOCHS = 8
BATCH = 64
RATE = 0.03
SCALE = 50.0   # of the mean before the softmax; the rate of telling words is low
NEUTRAL = 20   # words of score 0 added to every mean, so that a few words do not decide alone
CACHE = 250_000
TRAIN_CACHE = 100_000
LONG = 64      # longest word taken whole; longer ones are cut into such parts
ROWS = 1024

_EDGE = b".,;:!?\"'()[]{}*#$%&|<>-"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without the punctuation around them, in parts of
    ``LONG`` bytes at most; words of punctuation alone stay."""
    out = []
    for w in (text or "").lower().encode("utf-8", "replace").split():
        w = w.strip(_EDGE) or w
        if len(w) <= LONG:
            out.append(w)
        else:
            out.extend(w[i:i + LONG] for i in range(0, len(w), LONG))
    return out


def subwords(word: bytes) -> list[int]:
    """Buckets of a word's n-grams and of the word."""
    marked = b"<" + word + b">"
    grams = {marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    grams.add(b"=" + marked)
    return [zlib.crc32(g) % BUCKETS for g in sorted(grams)]


def bag(text: str | None, cache: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text: the mean over its distinct words of the
    mean over their subwords, as weights."""
    subs = []
    for w in sorted(set(words(text))) or [b""]:
        got = cache.get(w)
        if got is None:
            if len(cache) >= TRAIN_CACHE:
                cache.clear()
            got = cache[w] = np.array(subwords(w), np.int32)
        subs.append(got)
    n = np.fromiter(map(len, subs), np.int64, len(subs))
    at, where = np.unique(np.concatenate(subs), return_inverse=True)
    return at, np.bincount(where, weights=np.repeat(1 / (len(n) + NEUTRAL) / n, n)).astype(np.float32)


def train(texts: list[str | None], labels: list[int], weight: tuple[float, float] = (1.0, 1.0),
          epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): a document's logit is the bias plus the
    mean over its distinct words of the mean score of their subwords. With one class
    only, or no rows, the bias alone tells the class (0: nothing known)."""
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS), 0.0 if not labels else (6.0 if labels[0] else -6.0)
    cache: dict[bytes, np.ndarray] = {}
    bags = [bag(t, cache) for t in texts]
    del cache
    y = np.asarray(labels, np.int64)
    sample = np.where(y > 0, weight[1], weight[0])
    sample = sample / sample.mean()
    rng = np.random.default_rng(seed)
    # The embeddings start near 0, the softmax at random.
    params = [rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 1, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            sub = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick]) * SCALE
            n = np.array([len(bags[i][0]) for i in pick])
            emb, out, bias = params
            mean = np.add.reduceat(emb[sub] * share[:, None], np.cumsum(n) - n, axis=0)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            d = p * sample[pick][:, None] / len(pick)
            d_rows = np.repeat(d @ out.T, n, axis=0) * share[:, None]
            d_emb = np.stack([np.bincount(sub, d_rows[:, k], BUCKETS) for k in range(DIM)], axis=1)
            step += 1
            for i, (g, rate) in enumerate(((d_emb, RATE), (mean.T @ d, RATE / 4), (d.sum(axis=0), RATE))):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[i] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    emb, out, bias = params
    return emb @ (out[:, 1] - out[:, 0]) * SCALE, float(bias[1] - bias[0])


class Scorer:
    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias, self.cache = buckets.tolist(), bias, {}

    def word(self, w: bytes) -> float:
        got = self.cache.get(w)
        if got is None:
            ids = subwords(w)
            got = sum(self.buckets[i] for i in ids) / len(ids)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[w] = got
        return got

    def text(self, text: str | None) -> float:
        bag = sorted(set(words(text)))
        logit = self.bias + sum(map(self.word, bag)) / (len(bag) + NEUTRAL)
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, logit))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of ``docs`` (doc_id, text) with ``labels``
    (doc_id, toxic). An id with several labels counts as toxic if any is."""
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    # Choose on ids and sizes; only the texts chosen move.
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(told, "doc_id")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    fits = rows.filter(F.col("size") <= max_bytes).select("doc_id", "y")
    some = [fits.filter(F.col("y") == y).orderBy(*order).limit(max_rows // 2) for y in (0, 1)]
    chosen = some[0].union(some[1]).distinct()
    # max_rows rows of max_bytes at most.
    texts = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    sample = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(max_rows).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())),
                      key=lambda r: (r[0], r[1] or ""))
        got = Counter(y for y, _ in rows)
        buckets, bias = train([t for _, t in rows], [y for y, _ in rows],
                              tuple(sizes.get(y, 0) / max(1, got[y]) for y in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([buckets.tobytes()], pa.binary()), pa.array([bias])], ["buckets", "bias"])

    # One task trains; the driver gets the scores of the buckets.
    model = sample.repartition(1).mapInArrow(run, "buckets binary, bias double").first()
    return (np.frombuffer(model.buckets), model.bias) if model else train([], [])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, the columns in ``keep``), one row per input row: the
    probability that the whole text is toxic. Null and empty texts score by
    the bias alone; repeated rows are scored each; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = shared._jbroadcast.id()
    # Under names of their own on the way, whatever they are called.
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(*shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = pa.array([scorer.text(t) for t in part.column(1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores, *part.columns[2:]],
                                                 ["doc_id", "score", *names])

    schema = ", ".join([f"doc_id {docs.schema[id_col].dataType.simpleString()}", "score double",
                        *(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))])
    sent = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names)])
    return sent.mapInArrow(run, schema).toDF("doc_id", "score", *keep)


def passed(docs: DataFrame, model: tuple[np.ndarray, float], cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``cut``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names).withColumn("none", F.lit(None).cast("int"))
    text = names[docs.columns.index("text")]
    return score(held, model, "none", text, tuple(names)).filter(F.col("score") < cut).select(*names).toDF(*docs.columns)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id, modulo 5, is not 0."""
    return docs.filter(id_remainder() != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(learning_rows(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", F.coalesce(id_remainder() == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
