"""Quality rules with risk-controlled thresholds.

Five rules reject a document whose signal is above a cutoff (share of symbol
characters, of repeated lines, of words in repeated 8-word windows, of capital
letters, mean word length). The cutoff of a rule in a stratum (language) is
the strictest of a fixed grid that the labelled documents of good quality
support: walking from lenient to strict, a cutoff stands while the exact
binomial test rejects "its false rejection rate exceeds alpha" and the walk
ends at the first that fails. The walk needs no correction along the grid
(fixed-sequence testing); over strata and rules the level is divided
(Bonferroni). So with probability 1 - delta, all strata at once, the rules
together reject at most ``ALPHA`` of the good documents of a stratum. A
stratum with too few labelled documents gets no cutoff and rejects nothing.

All of it is DataFrame functions: the row work is one projection per
document, the thresholds are an aggregate over the labelled rows, and the
binomial tail is a closed form (Stirling) times a short fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.text import SPACE
from lexaudit.session import cut_lineage

ALPHA = 0.02   # false rejections per stratum, all rules together
DELTA = 0.05   # chance that the statement above fails anywhere
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Cutoffs per rule, lenient to strict.
SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
LENGTHS = (60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)
GRID = {"symbols": SHARES, "dup_lines": SHARES, "repeats": SHARES, "capitals": SHARES, "word_length": LENGTHS}
WINDOW = 8


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Number of words that lie in ``size``-word windows found twice or more.

    Windows are 64-bit hashes of the words' hashes. Texts whose windows all
    differ stop there; in the others the windows are sorted by (hash,
    position), the positions of repeated ones are kept, and each covers the
    words up to the next such position, ``size`` at most."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)),
                           lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(size)]))

    def covered(hs: Column) -> Column:
        n = F.size(hs)
        pairs = F.array_sort(F.transform(hs, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(F.transform(s, lambda x, j: F.when(
            ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])), x["i"])),
            lambda i: i.isNotNull()))
        return let(F.array_sort(again), lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - i, F.lit(size)))),
            F.lit(0), lambda a, x: a + x))

    counted = let(hashes, lambda h: let(windows(h), lambda hs: F.when(
        F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0))))
    return F.when(F.size(words) > size, counted).otherwise(F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_capitals), one row per input row, over whole
    texts. Null text counts as empty: all counts 0."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("words", F.filter(F.split("t", f"{SPACE}+"), lambda w: w != ""))
    base = base.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")))
    return base.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
        (F.length("t") - count_chars(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        count_chars(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count_chars(F.col("t"), CAPITALS).cast("long").alias("n_capitals"))


def rates() -> dict[str, Column]:
    def per(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"),
            "repeats": per("n_repeat_words", "n_words"), "capitals": per("n_capitals", "word_chars"),
            "word_length": per("word_chars", "n_words")}


def ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, taken back by eight factors."""
    y = x + 9.0
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    below = F.lit(1.0)
    for k in range(1, 9):
        below = below * (x + float(k))
    return series - F.ln(below)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p (1 beyond): the term at k times the
    sum of the ratios of the terms below it, which fall at least as fast as a
    normal tail, so 200 + 40 sqrt(k) terms hold all that a double can."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.ln(F.lit(p)) + (n - k) * F.log1p(F.lit(-p)))
    terms = F.least(k, F.floor(200 + 40 * F.sqrt(k))).cast("int")
    one = F.lit(1.0)
    total = F.aggregate(
        F.sequence(F.lit(0), terms), F.struct(one.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")))["sum"]
    return F.when(k >= n * p, one).otherwise(F.least(one, top * total))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule): the cutoffs; null where the labelled
    documents support none. Labelled good: quality 1 in any label row."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1")
    held = measured.join(good.select("doc_id"), "doc_id", "left_semi")
    rules = rates()
    per_rule, strata = alpha / len(rules), held.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    counts = [F.struct(F.lit(r).alias("rule"), F.lit(j).alias("at"), F.lit(float(c)).alias("cutoff"),
                       F.sum((rules[r] > c).cast("long")).alias("k"))
              for r, grid in GRID.items() for j, c in enumerate(grid)]
    table = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("tests"))
    # strata is one row
    tested = table.join(F.broadcast(strata)).select("stratum", "n", "strata", F.inline("tests"))
    fails = binomial_tail(F.col("k"), F.col("n"), per_rule) > F.lit(delta) / (F.col("strata") * len(rules))
    tested = tested.withColumn("fails", fails)
    first = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(F.col("fails"), F.col("at"))).alias("stop"), F.collect_list(F.struct("at", "cutoff")).alias("grid"))
    last = F.array_max(F.filter("grid", lambda g: F.col("stop").isNull() | (g["at"] < F.col("stop"))))["cutoff"]
    return first.withColumn("cutoff", last).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in rules])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, **columns: str) -> DataFrame:
    """Signals, ``base_failed``, ``kept`` and ``failed_rules`` of each document.

    ``base_failed``: under 20 words, or more than 30 % of the words repeated.
    ``kept``: false if ``base_failed``, else whether no rule rejects. A null
    or unseen stratum has the cutoffs of its own labelled rows, or none. Null
    ids match no label; repeated rows are judged each; extra columns are
    ignored; empty tables give empty results."""
    measured = cut_lineage(signals(docs, **columns))
    limits = cutoffs(measured, labels, alpha, delta)
    joined = measured.alias("a").join(limits.alias("b"), F.col("a.stratum").eqNullSafe(F.col("b.stratum")), "left").select(
        "a.*", *[f"b.max_{r}" for r in GRID])
    failed = F.filter(F.array(*[F.when(rate > F.col(f"max_{r}"), F.lit(r)) for r, rate in rates().items()]),
                      lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
