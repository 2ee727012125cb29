"""Encoding and decoding with a SentencePiece BPE model, by backtracking.

A BPE model merges, again and again, the best-scored pair of neighbouring
parts. Its encoding of a text is the one sequence of pieces in which every two
neighbours are *compatible*: merging their joined text again gives just these
two. So pieces are laid from left to right, the longest first. All longest
matches come from one pass of an Aho-Corasick automaton over the text (of
reversed pieces over the reversed text, so that a match found by its end
starts where it is looked up). A piece that does not go with its left
neighbour gives way to its next shorter prefix; where none is left the
position is marked in a bitfield of failed positions and the piece before it
is shortened. Every position fails once at most.

Texts are cut where no piece can span: before white space that follows
another character, and around characters that no longer piece holds. What a
cut part encodes to depends on nothing else and is kept in a cache that a
worker carries from task to task, twice ``CACHE`` entries at most.

The model file is read on the driver from a path that is a parameter; its
bytes (a fixed size) go out as one broadcast.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.text import table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
CACHE = 300_000
LONGEST_KEPT = 256
ROWS = 256


def default_path() -> str:
    """Where the public model is installed."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: an integer, or the
    bytes of a string, a message or a fixed-width number."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores and text rules of a model file."""

    def __init__(self, data: bytes):
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        # Numbers of the fields and their defaults as the format states them.
        if (trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or normalizer.get(2)
                or normalizer.get(4, 1) or not normalizer.get(5, 1)
                or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only BPE models with byte fallback and plain text rules are supported")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        self.ranks = {p: order[scores[i]] for p, i in self.ids.items()}
        self.bytes = {int(self.names[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}


class Codec:
    def __init__(self, model: Model):
        self.model = model
        self.matches = ahocorasick.Automaton()
        for piece in model.ids:
            self.matches.add_word(piece[::-1], len(piece))
        self.matches.make_automaton()
        joined = {c for p in model.ids if len(p) > 1 for c in p}
        inside = "".join(map(re.escape, sorted(joined - {SPACE}))) or "\\Z"
        spanning = any(b == SPACE and a != SPACE for p in model.ids for a, b in zip(p, p[1:]))
        self.cut = re.compile(f"[{SPACE}{inside}]+|[^{SPACE}{inside}]" if spanning
                              else f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]")
        self.remade: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}
        # Ids of cut parts, those of late and those before them; texts of the
        # parts that do not decode to themselves.
        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.other: dict[str, str] = {}

    def merge(self, text: str) -> list[str]:
        """The merges as they are defined: best score first, then leftmost.
        Its time grows with the square of the length: for short texts."""
        parts, ranks = list(text), self.model.ranks
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a text that merges to the pieces a, b exists; with a empty,
        whether b merges to itself."""
        known = self.remade.get((a, b))
        if known is None:
            known = self.merge(a + b) == ([a, b] if a else [b])
            if len(self.remade) >= CACHE:
                self.remade.clear()
            self.remade[a, b] = known
        return known

    def prefix(self, piece: str) -> str | None:
        """The longest shorter piece (or single character) that it begins with."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1)
                                        if k == 1 or piece[:k] in self.model.ids), None)
        return self.shorter[piece]

    def pieces(self, text: str) -> list[str]:
        """The pieces of normalised text; characters that the model lacks are
        pieces of their own."""
        n = len(text)
        sizes = [1] * n
        for end, size in self.matches.iter(text[::-1]):
            if size > sizes[n - 1 - end]:
                sizes[n - 1 - end] = size
        failed = bytearray((n >> 3) + 1)
        remade, compatible = self.remade, self.compatible
        laid: list[str] = []
        left = ""
        at, piece = 0, text[:sizes[0]] if n else ""
        while at < n:
            end = at + len(piece)
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits:
                # A piece after another that merging makes of the two is whole itself.
                fits = remade.get((left, piece))
                if fits is None:
                    fits = compatible(left, piece)
            if fits:
                laid.append(piece)
                left, at = piece, end
                piece = text[at:at + sizes[at]] if at < n else ""
                continue
            less = self.prefix(piece)
            if less is None:
                if not laid:
                    raise ValueError("the model's merges fit no sequence of its pieces")
                failed[at >> 3] |= 1 << (at & 7)
                less = laid.pop()
                left = laid[-1] if laid else ""
                at -= len(less)
            piece = less
        return laid

    def part(self, text: str) -> bytes:
        """Ids of a cut part as little-endian uint32."""
        got = self.before.get(text)
        if got is None:
            known = self.model.ids
            ids: list[int] = []
            for piece in self.pieces(text):
                i = known.get(piece)
                if i is not None:
                    ids.append(i)
                else:
                    ids += [self.model.bytes[b] for b in piece.encode()]
            got = np.array(ids, "<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)
            decoded = self.surface(ids)
            if decoded != text.replace(SPACE, " "):
                self.other[text] = decoded
        if len(text) <= LONGEST_KEPT:
            self.late[text] = got
            if len(self.late) >= CACHE:
                self.before, self.late = self.late, {}
        return got

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian uint32, text that decoding them gives)."""
        if not text:
            return b"", ""
        known = self.late.get
        marked = self.model.prefix + text.replace(" ", SPACE)
        parts = self.cut.findall(marked)
        ids = b"".join([known(p) or self.part(p) for p in parts])
        if self.other:
            marked = "".join([self.other.get(p, p) for p in parts])
        return ids, marked.replace(SPACE, " ")[len(self.model.prefix):]

    def surface(self, ids: Iterable[int]) -> str:
        """The text of ids with the marks of white space as spaces; byte
        pieces in a row are UTF-8, a byte that fits in no character is U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            kind = self.model.kinds[i]
            if kind == BYTE:
                raw.append(int(self.model.names[i][3:5], 16))
                continue
            if raw:
                out.append(_characters(raw))
                raw.clear()
            if kind == NORMAL:
                out.append(self.model.names[i].replace(SPACE, " "))
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        return "".join(out) + _characters(raw)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; a leading space that encoding adds is dropped."""
        ids = [i for i in ids if self.model.kinds[i] != CONTROL]
        text = self.surface(ids)
        marked = bool(ids) and self.model.prefix and self.model.names[ids[0]].startswith(SPACE)
        return text[1:] if marked else text


def _characters(raw: bytearray) -> str:
    """Decoded bytes; each byte that is in no whole character is one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


# The codec that this worker made last, with its caches, by broadcast id.
_made: dict[int, Codec] = {}


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), one row per input row, in one pass without a
    shuffle. ids: array of piece ids without begin and end marks; decoded: the
    text that decoding them gives. Null and empty texts have no ids and decode
    to the empty text. Characters that the model lacks become the pieces of
    their UTF-8 bytes; names of control or byte pieces in a text are ordinary
    text. Repeated rows and null ids are encoded each; other columns are
    ignored."""
    spark = docs.sparkSession
    with open(path or default_path(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Codec(Model(shared.value))
        codec = _made[key]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                out = [codec.encode(t) for t in rows.column(1).to_pylist()]
                ids = np.frombuffer(b"".join([x[0] for x in out]), dtype="<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x[0]) // 4 for x in out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                     pa.array([x[1] for x in out], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of piece ids. Null and empty ids give the empty
    text; control pieces have no text; an id outside the model raises."""
    spark = rows.sparkSession
    with open(path or default_path(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _made:
            _made.clear()
            _made[key] = Codec(Model(shared.value))
        for batch in batches:
            texts = [_made[key].decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, text string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each whole document."""
    out = encode(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
