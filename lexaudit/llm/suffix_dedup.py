"""Removal of byte strings that also start in an earlier document.

Every ``length``-byte window has a minimizer: the least hash of its
``GRAM``-byte grams. Equal windows have equal minimizers, so windows that
share one (a run of neighbours is sent as one stretch of text) can be handled
in one shard, and a minimizer found in one document only needs no handling.

1. Documents are dealt to chunks of about ``CHUNK_BYTES`` by a hash; each
   chunk sends its distinct minimizers, packed, with their numbers of
   stretches, to their hash range.
2. A range sends back to each chunk the minimizers that occur in two documents
   or more, and tells which are hot: have stretches of a chunk's size or more in
   all, like those in a phrase that many texts share with other text around it.
3. A chunk sends the stretches around those to the minimizer's shard: distinct
   contents with their least and largest doc_id, so copies are folded before
   the shuffle. Stretches of a hot minimizer go as single windows, each to the
   shard of the hash of its bytes, so equal windows still meet but a minimizer
   is no longer one shard.
4. A shard suffix-sorts its contents by external induced sorting; neighbours
   with ``length`` common bytes form groups, and each window learns the least
   doc_id that has it. A content that alone has its minimizer has no window in
   common with another, so it needs no sorting. Contents with a window older
   than their own largest doc_id go back to the chunk.
5. A chunk covers, in each document, the windows that an earlier one has.

Chunks, ranges and shards grow in number with the input, not in size; what is
equal is folded per chunk, so a passage that a third of all documents share is
one row per chunk. Messages are compressed: contents by minimizer, numbers by
their differences. A shard is sorted in memory but for the induction queues.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.induced import suffixes, text_of
from lexaudit.llm.packing import pack, pack_bytes, pack_steps, unpack, unpack_bytes, unpack_steps
from lexaudit.llm.text import blocks_of

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 4 << 20
STEP = 1 << 15     # positions that are hashed at a time, few enough for the processor's cache
RUN = 64           # windows in one stretch at most


def flat_text(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of each text and the end) of a string column."""
    texts = pa.chunked_array(column).combine_chunks() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first:int(offsets[-1])], offsets - first


def minimizers(data: np.ndarray, length: int) -> np.ndarray:
    """The minimizer of the window that starts at each byte, as 48 bits;
    windows beyond the end have none and are left out."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    with np.errstate(over="ignore"):
        for at in range(0, n, STEP):
            x = data[at:min(at + STEP, n) + length - 1].astype(np.uint64)
            for shift in (1, 2, 4):   # 8 bytes from each place
                x = x[:-shift] | x[shift:] << np.uint64(8 * shift)
            m = len(x) - (GRAM - 8)
            h = x[:m] * k[0]
            for part in range(1, GRAM // 8):
                h = (h ^ (h >> np.uint64(29))) * k[3] + x[8 * part:8 * part + m] * k[part]
            h = (h ^ (h >> np.uint64(32))) * k[3]
            h ^= h >> np.uint64(29)
            grams, have = length - GRAM + 1, 1
            while 2 * have <= grams:
                h = np.minimum(h[:-have], h[have:])
                have *= 2
            if grams > have:
                h = np.minimum(h[:have - grams], h[grams - have:])
            # Least hashes crowd near 0; spread them over the ranges again.
            h = (h ^ (h >> np.uint64(31))) * k[1]
            out[at:at + len(h)] = h >> np.uint64(16)
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, usable: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(minimizer, first window, number of windows, text) of runs of windows
    with one minimizer inside one usable text."""
    values = minimizers(data, length)
    # A window that starts in the last bytes of a text reaches into the next.
    last = np.minimum(np.maximum(offsets[1:] - length + 1, offsets[:-1]), len(values))
    edges = np.unique(np.concatenate([np.flatnonzero(values[1:] != values[:-1]) + 1, offsets[:-1], last, [0, len(values)]]))
    edges = edges[edges <= len(values)]
    starts, sizes = edges[:-1], np.diff(edges)
    text = np.searchsorted(offsets, starts, "right") - 1
    some = usable[text] & (starts < last[text])
    starts, sizes, text = starts[some], sizes[some], text[some]
    # Long runs (repeated text) in pieces.
    pieces = -(-sizes // RUN)
    which = np.repeat(np.arange(len(starts)), pieces)
    part = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[which] + part * RUN
    return values[first], first, np.minimum(RUN, sizes[which] - part * RUN), text[which]


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def spread(keys: np.ndarray, groups: int) -> np.ndarray:
    """The hash range of 48-bit values."""
    return (keys.astype(np.float64) * (groups / 2.0 ** 48)).astype(np.int64)


def first_owners(contents: list[bytes], low: np.ndarray, minimizer: np.ndarray, hot: np.ndarray,
                 length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least doc_id of each window of the distinct ``contents``, first window
    of each content); ``low``: the least doc_id that has the content. Windows
    of ``hot`` minimizers have no equals but themselves."""
    windows = np.fromiter(map(len, contents), np.int64, len(contents)) - length + 1
    start = np.cumsum(windows) - windows
    least = np.repeat(low, windows)
    _, place, n = np.unique(minimizer, return_inverse=True, return_counts=True)
    some = np.flatnonzero((n[place] > 1) & ~hot)
    if not len(some):
        return least, start
    text, begin = text_of([contents[i] for i in some.tolist()])
    sizes = windows[some] + length - 1
    owner = np.repeat(np.arange(len(some), dtype=np.int32), sizes + 1)
    inside = np.arange(len(owner)) - begin[owner]
    window = inside < windows[some][owner]
    at = start[some][owner] + inside
    del inside
    for positions, prefix in suffixes(text, length):
        group = np.flatnonzero(np.append(True, prefix[1:] < length))
        many = np.diff(np.append(group, len(positions)))
        if (many > 1).any():
            # The end symbol is no window.
            positions = np.minimum(positions, len(owner) - 1)
            value = np.repeat(np.minimum.reduceat(low[some][owner[positions]], group), many)
            equal = np.repeat(many > 1, many) & window[positions]
            least[at[positions[equal]]] = value[equal]
    return least, start


def window_shard(window: bytes, groups: int) -> int:
    return int.from_bytes(blake2b(window, digest_size=8).digest(), "little") % groups


def whole_characters(piece: bytes, cut_before: bool, cut_after: bool) -> bytes:
    """``piece`` of a UTF-8 text without the rest of a character at an end
    where it was cut."""
    start, end = 0, len(piece)
    while cut_before and start < end and piece[start] & 0xC0 == 0x80:
        start += 1
    if cut_after:
        lead = end - 1
        while lead >= start and piece[lead] & 0xC0 == 0x80:
            lead -= 1
        if lead >= start and piece[lead] >= 0xC0:
            size = 2 if piece[lead] < 0xE0 else 3 if piece[lead] < 0xF0 else 4
            end = lead if lead + size > end else end
    return piece[start:end]


def by_group(groups: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, from, to) of an ascending array."""
    at = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    return [(int(groups[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(groups)))]


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = flat_text(table.column("text"))
    ids = table.column("doc_id").combine_chunks()
    usable = np.asarray(ids.is_valid())
    return data, offsets, usable, ids.fill_null(0).to_numpy()


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns)})


def repeats_removed(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id",
                    text_col: str = "text", keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, the columns in ``keep``), one row per
    input row. spans: the maximal removed runs (from, to) in bytes of the
    UTF-8 text; kept: the bytes that stay, if ``whole`` without the rests of
    characters that were cut.

    A byte goes if a ``length``-byte string of the input that covers it also
    starts in a document with a smaller doc_id. Null text is empty; texts
    shorter than ``length`` stay whole. A row with a null id keeps its text and
    removes none elsewhere; rows that share an id remove nothing from each
    other. Other columns are ignored; an empty table gives an empty result."""
    return _stages(docs, length, chunk_bytes, id_col, text_col, keep, whole)[1]


def _stages(docs: DataFrame, length: int, chunk_bytes: int, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = (), whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what is sent to the shards, the result of ``repeats_removed``)."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names)])
    parts = blocks_of(rows.agg(F.sum(F.octet_length("text"))).first()[0], chunk_bytes)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    hot_count = max(2, chunk_bytes // (RUN + length - 1))
    kept_types = {n: docs.schema[c].dataType.simpleString() for c, n in zip(keep, names)}

    def send(key: tuple, table: pa.Table) -> pa.Table:
        data, offsets, usable, ids = _documents(table)
        value, _, _, text = stretches(data, offsets, usable, length)
        order = np.lexsort((ids[text], value))
        value, owner = value[order], ids[text][order]
        fresh = np.append(True, value[1:] != value[:-1])[:len(value)]
        # Twice, if two documents of the chunk have it.
        other = np.append(False, (value[1:] == value[:-1]) & (owner[1:] != owner[:-1]))[:len(value)]
        twice = np.zeros(len(value), bool)
        if len(value):
            firsts = np.flatnonzero(fresh)
            twice[firsts] = np.logical_or.reduceat(other, firsts)
        out = np.repeat(value, fresh.astype(np.int64) + twice)
        # The number of stretches goes with the first of two.
        times = np.zeros(len(out), np.int64)
        if len(out):
            first = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
            times[first] = np.minimum(np.diff(np.append(firsts, len(value))), 65535)
        return _table({"part": pa.int32(), "chunk": pa.int32(), "data": pa.binary(), "times": pa.binary()},
                      [(g, key[0].as_py(), pack_steps(out[a:b]), pack(times[a:b])) for g, a, b in by_group(spread(out, parts))])

    def repeated(table: pa.Table) -> pa.Table:
        sent = [(c, unpack_steps(d).astype(np.uint64)) for c, d in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist())]
        times = np.concatenate([unpack(t) for t in table.column("times").to_pylist()])
        value, place, n = np.unique(np.concatenate([v for _, v in sent]), return_inverse=True, return_counts=True)
        hot = value[(n > 1) & (np.bincount(place, times, len(value)) >= hot_count)]
        value = value[n > 1]
        back = [(c, np.unique(v[is_in(v, value)])) for c, v in sent]
        return _table({"chunk": pa.int32(), "data": pa.binary(), "hot": pa.binary()},
                      [(c, pack_steps(v), pack_steps(v[is_in(v, hot)])) for c, v in back if len(v)])

    def candidates(table: pa.Table, answer: pa.Table, column: str):
        """(stretches of the chunk whose minimizer is in the answer, data)."""
        known = [unpack_steps(d) for d in answer.column(column).to_pylist()]
        known = np.unique(np.concatenate(known)).astype(np.uint64) if known else np.zeros(0, np.uint64)
        data, offsets, usable, ids = _documents(table)
        value, first, n, text = stretches(data, offsets, usable, length)
        some = is_in(value, known)
        return data, offsets, ids, value[some], first[some], n[some], text[some]

    def cut(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        schema = {"part": pa.int32(), "chunk": pa.int32(), "sizes": pa.binary(), "low": pa.binary(), "high": pa.binary(),
                  "minimizer": pa.binary(), "data": pa.binary(), "hot": pa.bool_()}
        if not answer.num_rows or not table.num_rows:
            return _table(schema, [])
        data, _, ids, value, first, n, text = candidates(table, answer, "data")
        raw = data.tobytes()
        hot = is_in(value, np.unique(np.concatenate([unpack_steps(d) for d in answer.column("hot").to_pylist()])).astype(np.uint64))
        # A hot stretch is cut into its windows.
        each = np.where(hot, n, 1)
        first = np.repeat(first, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        value, text, hot, n = (np.repeat(x, each) for x in (value, text, hot, np.where(hot, 1, n)))
        found: dict[bytes, list[int]] = {}
        for v, a, b, i, h in zip(value.tolist(), first.tolist(), (first + n + length - 1).tolist(), ids[text].tolist(), hot.tolist()):
            got = found.setdefault(raw[a:b], [i, i, v, h])
            if i < got[0]:
                got[0] = i
            elif i > got[1]:
                got[1] = i
        least, most, minimizer, hot = (np.array([x[k] for x in found.values()], kind)
                                       for k, kind in enumerate((np.int64, np.int64, np.uint64, bool)))
        shard = spread(minimizer, parts)
        contents = list(found)
        for place in np.flatnonzero(hot).tolist():
            shard[place] = window_shard(contents[place], parts)
        shard = 2 * shard + hot
        order = np.lexsort((minimizer, shard))
        out = []
        for g, a, b in by_group(shard[order]):
            mine = order[a:b]
            some = [contents[i] for i in mine.tolist()]
            out.append((g // 2, key[0].as_py(), pack(np.fromiter(map(len, some), np.int64, len(some))), pack(least[mine]),
                        pack(most[mine] - least[mine]), pack_steps(minimizer[mine]), pack_bytes(b"".join(some)), bool(g % 2)))
        return _table(schema, out)

    def sort(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        sent = []
        for r in table.to_pylist():
            ends = np.cumsum(unpack(r["sizes"]))
            data, at = unpack_bytes(r["data"]), ends.tolist()
            places = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip([0, *at], at)), np.int64, len(at))
            least = unpack(r["low"])
            sent.append((r["chunk"], places, least, least + unpack(r["high"]), unpack_steps(r["minimizer"]), r["hot"]))
        contents = list(number)
        del number
        low, minimizer, hot = np.full(len(contents), np.iinfo(np.int64).max), np.zeros(len(contents), np.int64), np.zeros(len(contents), bool)
        for _, places, mine, _, value, is_hot in sent:
            low[places] = np.minimum(low[places], mine)
            minimizer[places], hot[places] = value, is_hot
        least, start = first_owners(contents, low, minimizer, hot, length)
        oldest, windows = np.minimum.reduceat(least, start), np.diff(np.append(start, len(least)))
        out = []
        for chunk, places, _, high, value, _ in sent:
            older = np.flatnonzero(oldest[places] < high)
            if len(older):
                places = places[older]
                n = windows[places]
                at = np.repeat(start[places] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                out.append((chunk, pack_steps(value[older]), pack(n + length - 1),
                            pack_bytes(b"".join(contents[i] for i in places.tolist())), pack_steps(least[at])))
        return _table({"chunk": pa.int32(), "minimizer": pa.binary(), "sizes": pa.binary(), "data": pa.binary(),
                       "least": pa.binary()}, out)

    def remove(table: pa.Table, answer: pa.Table) -> pa.Table:
        data, offsets, ids, value, first, n, text = candidates(table, answer, "minimizer")
        number: dict[bytes, int] = {}
        told, count, single = [], [], [np.zeros(0, np.int64)]   # single: minimizers with windows alone
        for r in answer.to_pylist():
            told.append(unpack_steps(r["least"]))
            sizes, content = unpack(r["sizes"]), unpack_bytes(r["data"])
            single.append(unpack_steps(r["minimizer"])[sizes == length])
            count.append(sizes - length + 1)
            ends = np.cumsum(sizes).tolist()
            for x, y in zip([0, *ends], ends):
                number[content[x:y]] = len(number)
        raw = data.tobytes()
        gone = np.zeros(len(data) + 1, np.int32)
        if number:
            least, count = np.concatenate(told), np.concatenate(count)
            start = np.cumsum(count) - count
            oldest, newest = np.minimum.reduceat(least, start), np.maximum.reduceat(least, start)
            owner, end = ids[text], first + n + length - 1
            place = np.fromiter((number.get(raw[x:y], -1) for x, y in zip(first.tolist(), end.tolist())), np.int64, len(first))
            whole_run = (place >= 0) & (newest[place] < owner)
            np.add.at(gone, first[whole_run], 1)
            np.subtract.at(gone, end[whole_run], 1)
            part = (place >= 0) & ~whole_run & (oldest[place] < owner)
            for a, p, i in zip(first[part].tolist(), place[part].tolist(), owner[part].tolist()):
                at = a + np.flatnonzero(least[start[p]:start[p] + count[p]] < i)
                gone[at] += 1
                gone[at + length] -= 1
            alone = (place < 0) & is_in(value, np.unique(np.concatenate(single)).astype(np.uint64))
            for a, m, i in zip(first[alone].tolist(), n[alone].tolist(), owner[alone].tolist()):
                for x in range(a, a + m):
                    p = number.get(raw[x:x + length], -1)
                    if p >= 0 and oldest[p] < i:
                        gone[x] += 1
                        gone[x + length] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            here = covered[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
            spans = edges.reshape(-1, 2).tolist()
            if whole and spans:
                stay = b"".join(whole_characters(raw[a + x:a + y], x > 0, y < b - a) for x, y in
                                zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), b - a]))
            else:
                stay = data[a:b][~here].tobytes() if spans else raw[a:b]
            rows.append((b - a, [{"from": x, "to": y} for x, y in spans], stay))
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        out = _table({"n_bytes": pa.int64(), "spans": span, "kept": pa.binary()}, rows)
        out = out.add_column(0, "doc_id", table.column("doc_id"))
        for name in names:
            out = out.append_column(name, table.column(name))
        return out

    sent = chunked.groupBy("chunk").applyInArrow(send, "part int, chunk int, data binary, times binary")
    answer = sent.groupBy("part").applyInArrow(repeated, "chunk int, data binary, hot binary")
    pieces = chunked.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(
        cut, "part int, chunk int, sizes binary, low binary, high binary, minimizer binary, data binary, hot boolean")
    older = pieces.groupBy("part").applyInArrow(
        sort, "chunk int, minimizer binary, sizes binary, data binary, least binary")
    extra = "".join(f", {n} {t}" for n, t in kept_types.items())
    out = chunked.groupBy("chunk").cogroup(older.groupBy("chunk")).applyInArrow(
        remove, f"doc_id long, n_bytes long, spans array<struct<from: long, to: long>>, kept binary{extra}")
    return pieces, out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(n).alias(c) for c, n in zip(keep, names)])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what 50-byte repeats leave of each document."""
    out = repeats_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the bytes that stay as text (a character that was cut is
    dropped, others are as they were) and its length; rows that lose all their
    words go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = repeats_removed(docs, keep=others, whole=True)
    out = out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).filter((F.size("spans") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
