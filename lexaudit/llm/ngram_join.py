"""Similarity join of documents on five-word shingles by parity sketches.

A document's set is split into K parts by a hash; a part's sketch is the bits
that its shingles toggle (kept as the exclusive or of their 64-bit hashes).
Every shingle in one set only can change one part, so the number of parts in
which two sketches differ is at most the size of the sets' symmetric
difference, which for linked documents of sizes a and b is at most
(a + b) / 9. By the pigeonhole principle two linked documents agree in at
least K - d parts. K is fixed per size band; a document takes part in its own
band and, in the lower quarter, in the band below, as the larger one.

Of a document's parts only the d + 1 rarest are join keys (by the number of
different sets that have them, one order for all): the rarest part on which two
linked documents agree is among them on both sides. Parts that nobody else has
count, so a document without near copies usually drops out here, and a part
that very many have is only used where nothing rarer is left.

Equal sets are one class from the start. Candidate pairs are verified exactly
on the whole shingle sets, in two rounds, each followed by the connected
components: two hubs per class, among the classes with the most company under
its keys; then all pairs of classes in different components that share a key
and whose whole sketches, of one bit for each of ``BITS`` hash classes of
shingles, differ in (a + b) / 9 bits at most: that many differ at most where the
sets are linked. So no link between components is left out, no group is expanded
into pairs that are known to be connected, and texts that merely share parts
with a group meet its members in the join condition only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.graph import components
from lexaudit.llm.packing import pack, unpack
from lexaudit.llm.suffix_dedup import by_group, is_in, spread
from lexaudit.llm.text import blocks_of
from lexaudit.session import cut_lineage

SHINGLE = 5
CHUNK_BYTES = 4 << 20      # of text that a task holds as words
PART_BYTES = 48 << 20      # of text per range of keys
BITS = 512                 # of a whole set's sketch
_SKETCH = [f"s{k}" for k in range(BITS // 64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(1 << 47)  # marks the key of an empty part
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, BANDS[-1] * 3 // 2))
EDGES = np.array(BANDS, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MUL
        x = (x ^ (x >> np.uint64(29))) * _MIX
        return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles in ascending order, start of
    each text and the end)."""
    number: dict[bytes, int] = {}
    counts, ids = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        counts[i] = len(ws)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    word = hashes[np.concatenate(ids)] if ids else hashes
    ends = np.cumsum(counts)
    # A short text is one shingle of all its words: pad its end with zeros.
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - counts, n)
    out = mixed(np.minimum(counts, size).astype(np.uint64))[text]
    with np.errstate(over="ignore"):
        for k in range(size):
            at = first + k
            inside = at < ends[text]
            out = mixed(out * _MIX + np.where(inside, word[np.minimum(at, max(len(word) - 1, 0))] if len(word) else 0, 0).astype(np.uint64))
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.append(True, (out[1:] != out[:-1]) | (text[1:] != text[:-1]))[:len(out)]
    return out[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def set_classes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set: equal for equal sets."""
    n = np.diff(starts)
    some = n > 0
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(values):
        with np.errstate(over="ignore"):
            a[some] = np.add.reduceat(mixed(values), starts[:-1][some])
            b[some] = np.bitwise_xor.reduceat(mixed(values ^ _MIX), starts[:-1][some])
            a = mixed(a + mixed(b ^ n.astype(np.uint64)))
    return (a >> np.uint64(1)).astype(np.int64)


def whole_sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``BITS`` parity bits per set: which hash classes hold an odd
    number of its shingles. The rows of two sets differ in no more bits than
    the sets in shingles."""
    out = np.zeros((len(starts) - 1, BITS // 64), np.uint64)
    bit = mixed(values ^ _MUL) % np.uint64(BITS)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    np.bitwise_xor.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def reach(band: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of two linked sets whose smaller one is in
    the band."""
    return (EDGES[band + 1] - 1) // 4


def part_count(band: np.ndarray) -> np.ndarray:
    d = reach(band) + 1
    return d + d // 4 + 2


def sketch_keys(values: np.ndarray, starts: np.ndarray, classes: np.ndarray, band: np.ndarray):
    """Of sets as members of a band: (set, key) of the parts that are not empty,
    and of all parts where fewer than the prefix are not; and how many are not."""
    n, parts = np.diff(starts), part_count(band)
    base = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(n)), n)
    seeded = mixed(values ^ (band[owner].astype(np.uint64) + np.uint64(1)) * _MUL)
    slot = base[owner] + (seeded % parts[owner].astype(np.uint64)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, seeded = slot[order], mixed(seeded[order] ^ _MIX)
    at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
    sketch = np.bitwise_xor.reduceat(seeded, at) if len(at) else np.zeros(0, np.uint64)
    slot = slot[at]
    owner = np.searchsorted(base, slot, side="right") - 1
    place = (slot - base[owner]).astype(np.uint64)
    key = mixed(sketch + mixed(place * _MIX + band[owner].astype(np.uint64))) >> np.uint64(17)
    filled = np.bincount(owner, minlength=len(n))
    poor = np.flatnonzero(filled < np.minimum(n // 4, reach(band)) + 1)
    more_owner, more_key = [owner], [key]
    for i in poor.tolist():
        lack = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), place[owner == i])
        more_owner.append(np.full(len(lack), i))
        more_key.append(mixed(lack * _MUL + np.uint64(band[i])) >> np.uint64(17) | _EMPTY)
    return np.concatenate(more_owner), np.concatenate(more_key), filled


def chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about ``most`` bytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            n = len(t or "")
            if texts and size + n > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n
    if texts:
        yield ids, texts


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls): size and class of each row's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunked(batches, CHUNK_BYTES):
            values, starts = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(starts)),
                                              pa.array(set_classes(values, starts))], ["doc_id", "n", "cls"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long")


_UNIT = np.dtype([("cls", "<i8"), ("n", "<i8"), ("band", "<i4"), ("filled", "<i4"), ("count", "<i4")])


def shared_keys(docs: DataFrame) -> DataFrame:
    """(key, cls, n): the join keys of the classes that may have a partner."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = blocks_of(total, PART_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunked(batches, CHUNK_BYTES):
            values, starts = shingle_sets(texts)
            classes, first = np.unique(set_classes(values, starts), return_index=True)
            size = np.diff(starts)[first]
            classes, first, size = classes[size > 0], first[size > 0], size[size > 0]
            if not len(first):
                continue
            own = np.searchsorted(EDGES, size, side="right") - 1
            below = (own > 0) & (4 * size < 5 * EDGES[own])
            which = np.concatenate([np.arange(len(first)), np.flatnonzero(below)])
            band = np.concatenate([own, own[below] - 1])
            at = [np.arange(starts[i], starts[i + 1]) for i in first[which].tolist()]
            ends = np.append(0, np.cumsum(size[which]))
            owner, key, filled = sketch_keys(values[np.concatenate(at)], ends, classes[which], band)
            part = spread(key & (_EMPTY - np.uint64(1)), 2 * parts)
            order = np.lexsort((owner, part))
            part, owner, key = part[order], owner[order], key[order]
            rows = []
            for p, a, b in by_group(part):
                units, count = np.unique(owner[a:b], return_counts=True)
                told = np.zeros(len(units), _UNIT)
                told["cls"], told["n"] = classes[which[units]], size[which[units]]
                told["band"], told["filled"], told["count"] = band[units], filled[units], count
                rows.append((p, told.tobytes(), pack(key[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], ["part", "units", "keys"])

    found = np.dtype([("cls", "<i8"), ("n", "<i8"), ("band", "<i4"), ("filled", "<i4"), ("key", "<u8"), ("freq", "<i8")])

    def count(table: pa.Table) -> pa.Table:
        units = np.concatenate([np.frombuffer(u, _UNIT) for u in table.column("units").to_pylist()])
        key = np.concatenate([unpack(k, np.uint64) for k in table.column("keys").to_pylist()])
        who = np.repeat(np.arange(len(units)), units["count"])
        order = np.lexsort((units["cls"][who], key))
        key, who = key[order], who[order]
        cls = units["cls"][who]
        # A class that several chunks have counts once.
        once = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
        key, who = key[once], who[once]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        freq = np.diff(np.append(at, len(key)))
        many = np.repeat(freq > 1, freq)
        out = np.zeros(int(many.sum()), found)
        for name in ("cls", "n", "band", "filled"):
            out[name] = units[name][who[many]]
        out["key"], out["freq"] = key[many], np.repeat(freq, freq)[many]
        group = (out["cls"] % parts).astype(np.int64)
        order = np.argsort(group, kind="stable")
        out, group = out[order], group[order]
        rows = [(g, out[a:b].tobytes()) for g, a, b in by_group(group)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def choose(table: pa.Table) -> pa.Table:
        got = np.concatenate([np.frombuffer(d, found) for d in table.column("data").to_pylist()])
        empty = got["key"] >= _EMPTY
        got = got[np.lexsort((got["key"], np.where(empty, 1 << 40, got["freq"]), got["band"], got["cls"]))]
        empty = got["key"] >= _EMPTY
        at = np.flatnonzero(np.append(True, (got["cls"][1:] != got["cls"][:-1]) | (got["band"][1:] != got["band"][:-1])))
        size = np.diff(np.append(at, len(got)))
        unit = np.repeat(np.arange(len(at)), size)
        full = np.bincount(unit, weights=~empty, minlength=len(at)).astype(np.int64)
        prefix = np.minimum(got["n"][at] // 4, reach(got["band"][at])) + 1
        wanted = prefix - (got["filled"][at] - full)
        rank = np.arange(len(got)) - at[unit]
        some = (rank < wanted[unit]) & ~empty | empty & (wanted > full)[unit]
        return pa.table({"key": pa.array(got["key"][some].astype(np.int64)), "cls": pa.array(got["cls"][some]),
                         "n": pa.array(got["n"][some])})

    sent = docs.select("doc_id", "text").mapInArrow(send, "part int, units binary, keys binary")
    counted = sent.groupBy("part").applyInArrow(count, "part int, data binary")
    return counted.groupBy("part").applyInArrow(choose, "key long, cls long, n long")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 80 % of their union in common."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = int(is_in(x, y).sum())
                keep.append(100 * same >= 80 * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Texts without words (or null) have no shingles and link with nothing. Rows
    that share an id are one node; a row with a null id links with nothing and
    has a null component. Other columns are ignored; an empty table gives an
    empty result. Set names and shingles are 64-bit hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = cut_lineage(describe(rows))
    usable = rows.filter("doc_id is not null")
    keyed = cut_lineage(shared_keys(usable))
    firsts = told.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    wanted = keyed.select("cls").distinct().join(firsts, "cls")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunked(batches, CHUNK_BYTES):
            values, starts = shingle_sets(texts)
            raw = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            bits = whole_sketches(values, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_classes(values, starts)), pa.array(raw, pa.binary()), *(pa.array(b) for b in bits.T.copy())],
                ["cls", "items", *_SKETCH])

    kind = ", ".join(["cls long", "items binary", *(f"{c} long" for c in _SKETCH)])
    sets = cut_lineage(usable.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(
        items, kind).dropDuplicates(["cls"]))

    # The class with the most company under its keys is the hub of a key: the
    # text that near copies were made from shares more parts with each of them
    # than they do with one another.
    company = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    degrees = keyed.join(company, "key").groupBy("cls").agg(F.sum("f").alias("degree"))
    hubs = keyed.join(degrees, "cls").groupBy("key").agg(F.max(F.struct("degree", "cls", "n")).alias("hub"))
    near = keyed.join(hubs, "key").filter("cls <> hub.cls and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    near = near.groupBy(F.col("cls").alias("a")).agg(F.max("hub").alias("best"), F.min("hub.cls").alias("other"))
    near = cut_lineage(near.select("a", F.explode(F.array_distinct(F.array("best.cls", "other"))).alias("b")))
    # Rows of one id with different sets are one node.
    same_id = told.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select("doc_id", "a")
    links = told.join(same_id, "doc_id").filter("cls <> a and n > 0").select("cls", "a").toDF("a", "b")

    links = cut_lineage(links.union(linked(near, sets)))
    groups = components(links)
    named = groups.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
    members = keyed.withColumnRenamed("cls", "a").join(named, "a", "left").withColumn("c_a", F.coalesce("c_a", "a"))
    open_keys = members.groupBy("key").agg(F.min("c_a").alias("lo"), F.max("c_a").alias("hi")).filter("lo <> hi")
    left = members.join(open_keys.select("key"), "key", "left_semi")
    left = left.join(sets.select(F.col("cls").alias("a"), *_SKETCH), "a")
    right = left.select("key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("c_a").alias("c_b"),
                        *(F.col(c).alias(f"o{c}") for c in _SKETCH))
    differ = " + ".join(f"bit_count({c} ^ o{c})" for c in _SKETCH)
    more = left.join(right, "key").filter(
        f"a > b and c_a <> c_b and 5 * least(n, m) >= 4 * greatest(n, m) and 9 * ({differ}) <= n + m")
    more = cut_lineage(more.select("a", "b").distinct())
    if not more.isEmpty():
        new = cut_lineage(linked(more, sets))
        if not new.isEmpty():
            groups = components(links.union(new))

    named = told.join(groups, told.cls == groups.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("label"))
    some = named.filter("n_shingles > 0 and doc_id is not null")
    smallest = some.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    rest = named.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(smallest, "label").select("doc_id", "n_shingles", "component_id").union(rest)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingle similarity of 0.8 or more."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component. Rows with
    a null id and without words stay."""
    kept = similar_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    stays = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(stays)
