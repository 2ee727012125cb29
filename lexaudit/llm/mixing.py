"""Mixing sources to target weights in fixed-length blocks.

The words of a source form one stream (documents in a hashed order), cut into
blocks of ``block`` words. A source's target decides how many words are
drawn: whole passes over the stream and a part of a last pass. A pass visits
the blocks in the order of a pseudorandom permutation of their indexes.

The slots of a source (pass by pass) are dealt to the output shards by one
multinomial draw: each slot draws a shard, the draws are only counted, and the
counts become ranges of the source's slots, one range per shard. So the counts
per shard are multinomial given the total, which the target fixes. Inside a
shard the slots of all sources are put in the order of one more permutation,
and a slot finds its block by index: slot number -> (pass, position) ->
permuted block.

No source is gathered in one task: streams are numbered by 1,024 hashed cells
per source (cell totals first, then inside a cell), slots are drawn and made
from ranges of 8,192 indexes, and the join key is (source, block). The table
of the drawn counts has one row per source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaudit.llm.text import WORD, n_words
from lexaudit.session import cut_lineage

CELLS = 1024
RANGE = 8192
ROUNDS = 16


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, src, target) from (source, source_size).

    Sources take the weights in turn, by code point, null last. A target is
    weight x level, at most ``most`` x its size; what is cut off is shared by
    weight among the others. Sources in the order of size / weight are full
    as long as that quotient is under the level left for them, so the level
    is found with one running sum. The table has one row per source."""
    ranked = sizes.withColumn("src", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.col("source_size") * F.lit(float(most)))
    w = Window.orderBy(F.col("full") / F.col("weight"), "src")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0.0)
    level = ((F.sum("source_size").over(whole) * share - F.coalesce(F.sum("full").over(before), none))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none)))
    ranked = ranked.withColumn("level", level)
    is_full = F.col("full") <= F.col("level") * F.col("weight")
    last = F.min(F.when(~is_full, F.struct(F.col("full") / F.col("weight"), "src", "level"))).over(whole)
    return ranked.select("source", "source_size", "src", F.when(
        is_full, F.col("full")).otherwise(last["level"] * F.col("weight")).alias("target"))


def permute(x: Column, n: Column, keys: list[Column], rounds: int = ROUNDS) -> Column:
    """The image of ``x`` under a pseudorandom permutation of [0, n): the
    swap-or-not shuffle, a bijection for any n. Each round pairs x with
    (k - x) mod n and swaps the pair if a hash of its larger member and the
    round is even."""
    def step(x: Column, r: Column) -> Column:
        pair = F.array(F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x, n))
        return F.transform(pair, lambda y: F.when(
            F.xxhash64(F.greatest(x, y), *keys, -1 - r).bitwiseAND(1) == 0, y).otherwise(x))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def _numbered(ranges: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """A row with ``g`` for each number from ``lo`` to ``hi`` - 1 of a range,
    made by ``tasks`` tasks in pieces of RANGE numbers."""
    parts = ranges.withColumn("from", F.explode(F.sequence(
        F.col("lo"), F.col("hi") - 1, F.lit(RANGE).cast("long"))))
    return parts.repartition(tasks, *keys, "from").withColumn("g", F.explode(F.sequence(
        F.col("from"), F.least(F.col("from") + RANGE - 1, F.col("hi") - 1)))).drop("from")


def draw_counts(totals: DataFrame, out_shards: int, seed: int, tasks: int) -> DataFrame:
    """(src, shard, n, lo, hi, base, shard_slots) from (src, n_slots).

    n is the multinomial count of the source in the shard, [lo, hi) the range
    of the source's slots that it takes, base the number of the shard's slots
    that belong to sources before it and shard_slots their number in all. Pairs
    with a count of 0 have no row."""
    draws = _numbered(totals.select("src", F.lit(0).cast("long").alias("lo"), F.col("n_slots").alias("hi")), tasks, "src")
    counts = draws.groupBy("src", F.pmod(F.xxhash64("src", "g", F.lit(~seed)), F.lit(out_shards)).alias("shard")).agg(
        F.count("*").alias("n"))
    before = (Window.unboundedPreceding, -1)
    of_src = Window.partitionBy("src").orderBy("shard").rowsBetween(*before)
    of_shard = Window.partitionBy("shard")
    counts = counts.withColumns({
        "lo": F.coalesce(F.sum("n").over(of_src), F.lit(0)),
        "base": F.coalesce(F.sum("n").over(of_shard.orderBy("src").rowsBetween(*before)), F.lit(0)),
        "shard_slots": F.sum("n").over(of_shard)})
    return counts.withColumn("hi", F.col("lo") + F.col("n"))


def deal_slots(goals: DataFrame, block: int, out_shards: int, seed: int, tasks: int) -> DataFrame:
    """(src, epoch, block, words, shard, slot): the slots of the mix.

    ``slot`` is gapless from 0 in each shard; the slot takes the first
    ``words`` words of block ``block`` of the source's stream."""
    span = F.lit(block).cast("long")
    by_src = goals.filter(F.col("source_size") > 0).select(
        "src", "source_size", F.round("target").cast("long").alias("goal"),
        F.floor(F.col("source_size") / span).alias("n_full"), F.ceil(F.col("source_size") / span).alias("per_pass"))
    by_src = by_src.filter("goal > 0").withColumn("last", F.floor((F.col("goal") - 1) / F.col("source_size")))
    by_src = by_src.withColumn("n_slots", F.col("last") * F.col("per_pass") + F.ceil(
        (F.col("goal") - F.col("last") * F.col("source_size")) / span))
    ranges = draw_counts(by_src, out_shards, seed, tasks).join(by_src.drop("n_slots", "last"), "src")
    slots = _numbered(ranges, tasks, "src", "shard")
    slots = slots.withColumn("epoch", F.floor(F.col("g") / F.col("per_pass")))
    slots = slots.withColumn("position", F.col("g") - F.col("epoch") * F.col("per_pass"))
    in_pass = F.least("source_size", F.col("goal") - F.col("epoch") * F.col("source_size"))
    # A pass has its full blocks in permuted order, the tail block last.
    image = permute(F.col("position"), F.col("n_full"), [F.col("src"), F.col("epoch"), F.lit(seed)])
    return slots.select(
        "src", "epoch", F.when(F.col("position") < F.col("n_full"), image).otherwise(F.col("position")).alias("block"),
        F.least(span, in_pass - F.col("position") * span).alias("words"), "shard",
        permute(F.col("base") + F.col("g") - F.col("lo"), F.col("shard_slots"), [F.col("shard"), F.lit(~seed)]).alias("slot"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        block: int = 256, out_shards: int = 64, seed: int = 11, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(located, taken)``.

    located: (doc_id, fp, source, size, source_size, target, src, start), one
    row per input row; ``start`` is where its words begin in its source's
    stream. taken: (src, start, epoch, shard, slot, first, words): the piece
    of that document that slot ``slot`` of output shard ``shard`` takes,
    ``words`` words from word ``first`` of the document on.

    Null text has no words; a null source is a source of its own, last; null
    and repeated ids are allowed (rows equal in id, source and text may swap
    places). Other input columns are ignored. Empty tables and sources without
    words give no pieces.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("fp")))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = cut_lineage(goals)
    rows = sized.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.*", "b.source_size", "b.target", "b.src")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "fp", F.lit(seed)), F.lit(CELLS)))
    cells = rows.groupBy("src", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("src", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "cell").orderBy("doc_id", "fp").rowsBetween(Window.unboundedPreceding, -1)
    located = cut_lineage(
        rows.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(cells, ["src", "cell"])
        .select("doc_id", "fp", "source", "size", "source_size", "target", "src",
                (F.col("base") + F.col("in_cell")).alias("start")))

    span = F.lit(block).cast("long")
    # A stated number: Spark would coalesce the few ranges into one task.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = deal_slots(goals, block, out_shards, seed, tasks)
    pieces = located.filter("size > 0").select("src", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("size") - 1) / span))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * span)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * span + F.col("words"))
    taken = pieces.join(slots.hint("merge"), ["src", "block"]).select(
        "src", "start", "epoch", "shard", "slot", (lo - F.col("start")).alias("first"), (hi - lo).alias("words"))
    return located, taken.filter("words > 0")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document, and the first place of the mix
    (output shard and slot) that takes some of it; null where none does."""
    located, taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = taken.groupBy("src", "start").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "slot")).alias("at"))
    cols = ["doc_id", "size", "source_size", "target"]
    some = located.filter("size > 0").join(sums, ["src", "start"], "left").select(
        *cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source",
        F.col("at.shard").cast("int").alias("first_shard"), F.col("at.slot").alias("first_slot"))
    none = located.filter("size = 0").select(
        *cols, F.lit(0).cast("long").alias("taken"), "source", F.lit(None).cast("int").alias("first_shard"),
        F.lit(None).cast("long").alias("first_slot"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words
    of it, with the words taken (whole text, or the runs of words its blocks
    cover, with the white space after them) and ``n_chars`` of the new text.
    Rows equal in id and text count as copies of one text row."""
    located, taken = mix(docs, **options)
    runs = taken.groupBy("src", "start", "epoch").agg(
        F.sum("words").alias("n"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("runs"))
    picked = located.filter("size > 0").join(runs, ["src", "start"]).select("doc_id", "fp", "size", "n", "runs")
    whole = docs.withColumn("fp", F.xxhash64("text")).dropDuplicates(["doc_id", "fp"])
    both = whole.alias("a").join(picked.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
                                 & (F.col("a.fp") == F.col("b.fp")))
    both = both.select(*[F.col(f"a.{c}") for c in docs.columns], "b.size", "b.n", "b.runs")
    words = F.regexp_extract_all("text", F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.transform("runs", lambda r: F.array_join(
        F.slice(w, r["first"].cast("int") + 1, r["words"].cast("int")), "")), ""))[0]
    out = both.withColumn("text", F.when(F.col("n") == F.col("size"), F.col("text")).otherwise(cut))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
