"""BPE encoding and decoding with a contiguous rank array.

A word is an array of parts and an array of the ranks of adjacent pairs.
Again and again the smallest rank is looked up by scanning, its boundary is
deleted, and the ranks of the two neighbouring pairs are refreshed. Words of
more than ``SHORT`` bytes take the same merges from a heap of (rank,
position), since scanning costs the square of the length.

Texts are cut at white space; what a piece of text between white space
encodes to depends on nothing else, so it is kept in a cache that a worker
carries from task to task and that holds ``CACHE`` entries at most; an entry
is the ids as bytes, and a text is decoded from the ids of the whole text.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.kept import kept
from lexaudit.llm.vocab import CHUNK, PIECE, WORD_END, Vocabulary, byte_chars, default_path, normalize

SHORT = 128
CACHE = 300_000
NEVER = 1 << 30
ROWS = 256


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    def __init__(self, vocab: Vocabulary):
        ids = vocab.ids
        self.names = {i: s for s, i in (*ids.items(), *vocab.special.items())}
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(vocab.merges):
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank)
            self.merged.append(ids[a + b])
        chars = byte_chars()
        # A symbol that the vocabulary lacks is left out, as without an unknown token.
        self.inner = [ids.get(c) for c in chars]
        self.last = [ids.get(c + WORD_END) for c in chars]
        self.special = vocab.special
        self.cut = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        """Ids of a piece of normalised text as little-endian uint32."""
        got = self.words.get(piece)
        if got is None:
            raw = piece.encode()
            parts = [i for i in (*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]) if i is not None]
            got = packed(self.scan(parts) if len(parts) <= SHORT else self.queue(parts))
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(raw) <= SHORT:
                self.words[piece] = got
        return got

    def scan(self, parts: list[int]) -> list[int]:
        pairs, merged = self.pairs, self.merged
        ranks = [pairs.get(a << 20 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NEVER:
                break
            i = ranks.index(rank)
            parts[i] = merged[rank]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get(parts[i - 1] << 20 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = pairs.get(parts[i] << 20 | parts[i + 1], NEVER)
        return parts

    def queue(self, parts: list[int]) -> list[int]:
        pairs, n = self.pairs, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[k], i) for i in range(n - 1) if (k := parts[i] << 20 | parts[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # Stale where either part has changed since.
            if parts[i] < 0 or j >= n or pairs.get(parts[i] << 20 | parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    found = pairs.get(parts[left] << 20 | parts[after[left]])
                    if found is not None:
                        heapq.heappush(heap, (found, left))
        return [p for p in parts if p >= 0]

    def chunk(self, text: str) -> bytes:
        """Ids of text without white space as little-endian uint32."""
        got = self.chunks.get(text)
        if got is None:
            ids: list[bytes] = []
            at = 0
            for m in self.cut.finditer(text) if self.cut and "<" in text else ():
                ids += self.plain(text[at:m.start()])
                ids.append(packed([self.special[m[0]]]))
                at = m.end()
            ids += self.plain(text[at:])
            got = ids[0] if len(ids) == 1 else b"".join(ids)
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            if len(text) <= SHORT:
                self.chunks[text] = got
        return got

    def plain(self, text: str) -> list[bytes]:
        return [self.word(piece) for piece in PIECE.findall(normalize(text))]

    def decode(self, ids: Iterable[int]) -> str:
        """Token texts with a space between; the vocabulary names no decoder.
        An id that it lacks is left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def text(self, text: str | None) -> tuple[int, bytes, str]:
        """(number of ids, ids as little-endian uint32, decoded text)."""
        ids = b"".join([self.chunk(c) for c in CHUNK.findall(text or "")])
        return len(ids) // 4, ids, self.decode(struct.unpack(f"<{len(ids) // 4}I", ids))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row per input row, in one pass
    without a shuffle. ids: little-endian uint32 values; decoded: the text
    that decoding them gives. Null and empty texts have no ids and decode to
    the empty text. Strings of special tokens in a text become their ids.
    Repeated rows are encoded each; other columns are ignored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(path or default_path()))
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(key, lambda: Codec(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [codec.text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in out], pa.int64()),
                     pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each whole document."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
