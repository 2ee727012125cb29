"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by seeded random rotations; the signs of its
coordinates are its code, and the code's inner product with the turned vector
is its correction factor; both are made once per vector and stored. The code's
product with another turned vector, divided by the factor, is an unbiased
estimate of the cosine, with a deviation known from the factor alone. The
other vector is held in four bits a coordinate, so the product is a count of
bits in a few words.

Groups of sign bits are also the keys of ``L`` hash tables: ``k`` bits grow
with the number of vectors, and L is chosen so that a pair right at the
threshold shares a key with probability ``RECALL``. Pairs meet in the first
table whose key they share; those whose estimate plus ``SIGMAS`` deviations
stays under the threshold are dropped, all others are computed again exactly,
in double precision. A bucket of over ``BLOCK`` rows is split into blocks and
its pairs of blocks are dealt to different tasks. No pairs leave a task: it
returns link counts per vector, and a star for each component that it sees.
Equal vectors are one class with a multiplicity throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.graph import components
from lexaudit.session import cut_lineage

RECALL = 0.995
SIGMAS = 5.0
BLOCK = 4096
CODE_BITS = 256
PLANES = 4
SEED = 23
PAIRS = 200_000


def tables(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits per key, number of tables) for ``n`` vectors."""
    k = max(6, math.ceil(math.log2(max(n, 2))) - 2)
    same = (1 - math.acos(threshold) / math.pi) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - same))


@lru_cache(maxsize=8)
def rotations(dim: int, bits: int) -> np.ndarray:
    """``bits`` rows or more: stacked random orthogonal matrices."""
    rng = np.random.default_rng([SEED, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))])


def code_width(dim: int) -> int:
    """Bits of a code: whole rotations only."""
    return max(CODE_BITS // dim, 1) * dim


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def code_part(unit: np.ndarray) -> np.ndarray:
    """Rows turned by the rotations of the code, of unit length again."""
    z = unit @ rotations(unit.shape[1], CODE_BITS)[:code_width(unit.shape[1])].T
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def coded(vectors: np.ndarray, k: int, n_tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factors) of rows of one length: what is
    stored of a vector. The first signs are the code, the first
    k * n_tables the keys of the tables."""
    unit = unit_rows(vectors)
    width = code_width(unit.shape[1])
    signs = unit @ rotations(unit.shape[1], max(k * n_tables, CODE_BITS)).T > 0
    z = code_part(unit)
    factor = np.where(signs[:, :width], z, -z).sum(axis=1) / math.sqrt(width)
    return np.packbits(signs, axis=1), np.maximum(factor, 1e-6)


def table_keys(signs: np.ndarray, k: int, n_tables: int) -> np.ndarray:
    """Key in each table, from packed signs."""
    bits = np.unpackbits(signs, axis=1, count=k * n_tables).reshape(len(signs), n_tables, k)
    return bits @ (1 << np.arange(k, dtype=np.int64))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Block:
    """Rows whose pairs are estimated and computed: what a pair needs of a row
    is made once per row. The turned side of an estimate is held in PLANES
    bits a coordinate, so that its product with a code is a count of bits."""

    def __init__(self, vectors: np.ndarray, signs: np.ndarray, factor: np.ndarray, k: int, n_tables: int):
        self.unit = unit_rows(vectors)
        self.factor = factor
        self.keys = table_keys(signs, k, n_tables)
        z = code_part(self.unit)
        self.root = math.sqrt(z.shape[1])
        self.code = words(np.unpackbits(signs, axis=1, count=z.shape[1]))
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.low = -np.abs(z).max(axis=1)
        self.step = -2 * self.low / (2 ** PLANES - 1)
        levels = np.rint((z - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [words(levels >> b & 1) for b in range(PLANES)]
        self.sums = z.sum(axis=1)
        self.spread = np.maximum(1 / factor ** 2 - 1, 0) / max(z.shape[1] - 1, 1)

    def estimate(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unbiased estimates of the cosines of the pairs, their deviations)."""
        code = self.code[a]
        met = sum((np.bitwise_count(code & plane[b]).sum(axis=1, dtype=np.int64) << p)
                  for p, plane in enumerate(self.planes))
        product = (2 * (self.low[b] * self.ones[a] + self.step[b] * met) - self.sums[b]) / self.root
        rounding = (self.step[b] / self.factor[a]) ** 2 / 6
        return product / self.factor[a], np.sqrt(self.spread[a] + rounding)

    def linked(self, i: np.ndarray, j: np.ndarray, table: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the pairs (i, j) meet here first and are linked."""
        guess, deviation = self.estimate(i, j)
        at = np.flatnonzero(guess + SIGMAS * deviation >= threshold)
        i, j = i[at], j[at]
        earlier = ((self.keys[i] == self.keys[j]) & (np.arange(self.keys.shape[1]) < table[i][:, None])).any(axis=1)
        at, i, j = at[~earlier], i[~earlier], j[~earlier]
        return at[np.einsum("nd,nd->n", self.unit[i], self.unit[j]) >= threshold]


def stacked(column: pa.Array) -> np.ndarray:
    """List column of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id), one row per input row.

    Two vectors of one length link if their cosine is at least ``threshold``.
    Null, empty and zero vectors, those with null or non-finite components,
    and rows with a null id link with nothing; their component is their id.
    Rows that share an id are one node of the components. Other columns are
    ignored; an empty table gives an empty result."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"))
    usable = (F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("ok", usable).withColumn("fp", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform(
        "vec", lambda x: F.hex(F.xxhash64(x)))), 256)))
    narrow = rows.select("vec_id", "fp")
    classes = cut_lineage(rows.filter("ok").groupBy("fp").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec")))
    k, n_tables = tables(classes.count(), threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("vec").value_lengths())
            for dim in np.unique(lengths):
                some = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                for at in range(0, some.num_rows, 512):
                    part = some.slice(at, 512)
                    signs, factor = coded(stacked(part.column("vec")), k, n_tables)
                    keys = table_keys(signs, k, n_tables)
                    stored = [*[part.column(c) for c in ("node", "m", "vec")],
                              pa.array([row.tobytes() for row in signs], pa.binary()), pa.array(factor)]
                    for t in range(n_tables):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), dim, np.int32)), pa.array(np.full(len(keys), t, np.int32)),
                             pa.array(keys[:, t]), *stored],
                            ["dim", "tab", "key", "node", "m", "vec", "signs", "factor"])

    kind = classes.schema["vec"].dataType.simpleString()
    entries = classes.select("node", "m", "vec").mapInArrow(
        keyed, f"dim int, tab int, key long, node long, m long, vec {kind}, signs binary, factor double")
    bucket = ["dim", "tab", "key"]
    # A bucket of one is no work; a large one becomes pairs of blocks.
    sizes = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = entries.join(sizes, bucket)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select(*bucket, F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"),
                     "own", "node", "m", "vec", "signs", "factor")
    dealt = met.repartition(*bucket, "b1", "b2").sortWithinPartitions(*bucket, "b1", "b2", "node")

    def work(rows: pa.Table) -> pa.RecordBatch:
        cols = {c: rows.column(c).to_numpy() for c in ("dim", "tab", "key", "b1", "b2", "own", "node", "m")}
        group = np.zeros(len(rows), np.int64)
        for c in ("dim", "tab", "key", "b1", "b2"):
            group[1:] |= cols[c][1:] != cols[c][:-1]
        group = np.cumsum(group)
        links, left, right = np.zeros(len(rows), np.int64), [], []
        vec, signs = rows.column("vec").combine_chunks(), rows.column("signs").to_pylist()
        factor = rows.column("factor").to_numpy()
        for dim in np.unique(cols["dim"]):
            mine = np.flatnonzero(cols["dim"] == dim)
            block = Block(stacked(vec.take(pa.array(mine))), np.frombuffer(
                b"".join(signs[x] for x in mine), np.uint8).reshape(len(mine), -1), factor[mine], k, n_tables)
            g, own, table = group[mine], cols["own"][mine], cols["tab"][mine]
            lone = cols["b1"][mine] == cols["b2"][mine]
            ends = np.searchsorted(g, g, side="right") - np.arange(len(g))
            first = np.arange(len(g))
            step = 1
            while len(first := first[ends[first] > step]):
                for at in range(0, len(first), PAIRS):
                    i = first[at:at + PAIRS]
                    j = i + step
                    ok = lone[i] | (own[i] != own[j])
                    i, j = i[ok], j[ok]
                    hit = block.linked(i, j, table, threshold)
                    i, j = mine[i[hit]], mine[j[hit]]
                    np.add.at(links, i, cols["m"][j])
                    np.add.at(links, j, cols["m"][i])
                    left.append(i)
                    right.append(j)
                step += 1
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        low = local_components(len(rows), i, j)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols["node"][some]), pa.array(links[some]), pa.array(cols["node"][low[some]])],
            ["node", "n", "hub"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at a time: the last group of what has come waits."""
        names = [*bucket, "b1", "b2"]
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = {c: batch.column(c)[batch.num_rows - 1] for c in names}
            cut = batch.num_rows
            same = np.ones(batch.num_rows, bool)
            for c in names:
                same &= batch.column(c).to_numpy() == ends[c].as_py()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield work(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield work(pa.Table.from_batches(waiting))

    found = cut_lineage(dealt.mapInArrow(joined, "node long, n long, hub long"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    told = classes.select("fp", "node", "m").join(links, "node", "left").join(groups, "node", "left").select(
        "fp", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = narrow.filter("fp is not null").join(told, "fp").select("vec_id", "n_links", "component_id")
    alone = narrow.filter("fp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
