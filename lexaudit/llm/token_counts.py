"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of
pieces that following it pops. Reading a word moves along the trie; where no
edge fits, the popped count is added and the link is followed, so a word
costs time linear in its length and no piece is ever built. The last byte of
a word is a symbol of its own (the word-end form of that byte)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.vocab import CHUNK, PIECE, WORD_END, Vocabulary, byte_chars, default_path, normalize

CACHE = 800_000
LONG = 128
ROWS = 1024


class Automaton:
    """Nodes are numbers, 0 the root; ``step[node << 9 | symbol]`` is an edge.
    Symbols: a byte, or 256 + byte for the last byte of a word."""

    def __init__(self, vocab: Vocabulary):
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.step: dict[int, int] = {}
        parent, symbol, whole = [0], [0], [False]
        for token in vocab.ids:
            ends = token.endswith(WORD_END) and token != WORD_END
            codes = [byte_of[c] for c in (token.removesuffix(WORD_END) if ends else token)]
            if ends:
                codes[-1] += 256
            node = 0
            for c in codes:
                child = self.step.get(node << 9 | c)
                if child is None:
                    child = self.step[node << 9 | c] = len(parent)
                    parent.append(node)
                    symbol.append(c)
                    whole.append(False)
                node = child
            whole[node] = True
        # Failure links in breadth-first order; -1: no piece fits.
        self.link, self.pops = [-1] * len(parent), [0] * len(parent)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                self.link[v], self.pops[v] = 0, 1
                continue
            u, c = parent[v], symbol[v]
            n, z = self.pops[u], self.link[u]
            while z >= 0 and (z << 9 | c) not in self.step:
                n += self.pops[z]
                z = self.link[z]
            self.pops[v], self.link[v] = n, self.step[z << 9 | c] if z >= 0 else -1
        self.cache: dict[str, int] = {}

    def word(self, piece: str) -> int:
        """Number of pieces of a normalised word; 1 where none fits (unknown)."""
        step, link, pops = self.step, self.link, self.pops
        codes = list(piece.encode())
        codes[-1] += 256
        node = n = 0
        for c in codes:
            while (to := step.get(node << 9 | c)) is None:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return n

    def text(self, text: str | None) -> int:
        total, cache = 0, self.cache
        for chunk in CHUNK.findall(text or ""):
            n = cache.get(chunk)
            if n is None:
                n = sum(map(self.word, PIECE.findall(normalize(chunk))))
                if len(cache) >= CACHE:
                    cache.clear()
                if len(chunk) <= LONG:
                    cache[chunk] = n
            total += n
        return total


_made: dict[int, Automaton] = {}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), one row per input row, in one pass without a
    shuffle. Null and empty texts have no tokens; strings of special tokens
    are ordinary text; repeated rows are counted each; other columns are
    ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path or default_path()))
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Automaton(shared.value)
        automaton = _made[key]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = [automaton.text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece length of each whole document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
