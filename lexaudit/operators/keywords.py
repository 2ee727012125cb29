"""Keyword counting, stopword stages and ranking (AGG1-AGG7, TOK8-TOK10)."""

from __future__ import annotations

import re
import unicodedata
from typing import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaudit.functions.batches import by_slices
from lexaudit.functions.scan import normalize_lists
from lexaudit.functions.text import normalize_token_udf
from lexaudit.functions.tokens import NOUN_ISLAND_RE, NOUN_TOKEN_RE, skip_basic_token
from lexaudit.operators.common import dealt_by, not_in_values, ordered_row_number
from lexaudit.settings import Settings


def setting_terms(*sources: str | Iterable[str] | None) -> list[str]:
    """TOK2, TOK10 for settings values (stopwords, phrases), which the driver
    holds: each source is a list of terms, or a text of terms between line
    ends and commas. Terms are NFKC-normalised, lower-cased and freed of white
    space; blanks go, and the first place of a term counts."""
    parts = (p for source in sources if source is not None
             for p in (re.split(r"[\r\n,\uff0c\u3001]", source) if isinstance(source, str) else map(str, source)))
    terms = ("".join(unicodedata.normalize("NFKC", p).split()).lower() for p in parts)
    return list(dict.fromkeys(filter(None, terms)))


def stopword_file_lines(lines: Iterable[str]) -> list[str]:
    """SRC5 on a list of lines: strip, skip blank and '#' lines, normalise."""
    return setting_terms(ln.strip() for ln in lines
                         if ln.strip() and not ln.strip().startswith("#"))


def default_stopword_set(settings: Settings) -> list[str]:
    return setting_terms(settings.default_stopwords) if settings.use_default_stopwords else []


def user_stopword_set(settings: Settings) -> list[str]:
    """TOK9: user file words (given as ``user_stopwords``) and the text box."""
    return setting_terms(settings.user_stopwords, settings.additional_stopwords_text)


def forced_phrase_list(settings: Settings) -> list[str]:
    return setting_terms(settings.forced_compounds, settings.forced_compounds_text)


def noun_occurrences(df: DataFrame, text_col: str, key_cols: Sequence[str] = (),
                     compound_mode: bool = True, per_text: bool = False) -> DataFrame:
    """Raw keyword occurrences of the built-in tagger, read straight off the
    text: with compounds on, a maximal run of adjacent noun tokens is one
    compound (a one-token run is the single noun); with compounds off, each
    noun token. One ``regexp_extract_all`` per text, no window, no shuffle.

    ``per_text``: the occurrences come normalised, as ``keyword``, a text's
    words together, exchanged by ``key_cols``, so that no later count by them
    moves a word. For counts by text, where nearly every word is distinct
    in its group and would pass to Python as a row of its own."""
    pattern = NOUN_ISLAND_RE if compound_mode else NOUN_TOKEN_RE
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), 1)
    if per_text:
        texts = df.select(*key_cols, _normalized_lists(words).alias("_words"))
        return dealt_by(texts, *key_cols).select(*key_cols, F.explode("_words").alias("keyword"))
    return df.select(*key_cols, F.explode(words).alias("raw"))


def _normalized_lists(words: Column) -> Column:
    def batch(lists: pa.Array) -> pa.Array:
        return by_slices(normalize_lists, pa.list_(pa.string()))(lists)

    batch.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "array<string>").asNondeterministic()(words)


def count_occurrences(occ: DataFrame, group_cols: Sequence[str] = (), raw_col: str = "raw") -> DataFrame:
    """Count raw tokens first (partial aggregation before the shuffle), then
    normalise each distinct raw string once (TOK2, vocabulary-sized Python
    work), apply TOK3 and re-aggregate by the normalised keyword. Occurrences
    that come normalised (``per_text``) are only filtered and counted."""
    if raw_col not in occ.columns:
        return count_normalized(occ.filter(~skip_basic_token(F.col("keyword"))), group_cols)
    raw_counts = occ.groupBy(*group_cols, raw_col).agg(F.count(F.lit(1)).alias("_n"))
    vocab = raw_counts.withColumn("keyword", normalize_token_udf(F.col(raw_col)))
    vocab = vocab.filter(~skip_basic_token(F.col("keyword")))
    return vocab.groupBy(*group_cols, "keyword").agg(F.sum("_n").cast("long").alias("freq"))


def count_normalized(tokens: DataFrame, group_cols: Sequence[str] = (), kw_col: str = "keyword") -> DataFrame:
    """Count keywords that are already normalised (general scan output)."""
    return tokens.groupBy(*group_cols, F.col(kw_col).alias("keyword")).agg(
        F.count(F.lit(1)).cast("long").alias("freq"))


def raw_frequency(counts: DataFrame, settings: Settings) -> DataFrame:
    """AGG2: counts after the default stopwords (tested on the vocabulary)."""
    return not_in_values(counts, "keyword", default_stopword_set(settings))


def final_frequency(raw: DataFrame, settings: Settings) -> DataFrame:
    """AGG3: raw counts minus the user stopwords."""
    return not_in_values(raw, "keyword", user_stopword_set(settings))


def rank_frequency(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG6: ranks 1..n by count desc, keyword asc (code point order)."""
    ranked = ordered_row_number(counts, [F.desc("freq"), F.asc("keyword")], group_cols, "rank")
    return ranked.select(*group_cols, "rank", "keyword", "freq")


def top_n(counts: DataFrame, n: int) -> DataFrame:
    """AGG7: top ``max(1, n)`` keywords with weight = freq / max freq.
    ``orderBy().limit()`` plans as TakeOrderedAndProject; the window then
    runs over at most n rows."""
    n = max(1, int(n))
    top = counts.orderBy(F.desc("freq"), F.asc("keyword")).limit(n)
    w = Window.orderBy(F.desc("freq"), F.asc("keyword"))
    return (top.withColumn("rank", F.row_number().over(w).cast("long"))
            .withColumn("weight", F.col("freq") / F.max("freq").over(Window.partitionBy()))
            .select("rank", "keyword", "freq", "weight"))


def top_n_per_group(counts: DataFrame, group_cols: Sequence[str], n: int) -> DataFrame:
    """Top n per group. The literal limit lets Spark plan a per-partition
    WindowGroupLimit before the shuffle, so a hot group sends at most n rows
    per map task."""
    w = Window.partitionBy(*group_cols).orderBy(F.desc("freq"), F.asc("keyword"))
    return (counts.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= int(n))
            .select(*group_cols, "rank", "keyword", "freq"))


def keyword_totals(raw: DataFrame, final: DataFrame) -> DataFrame:
    """AGG4: totals and distinct counts of both stages in one aggregate."""
    both = (raw.select(F.lit(True).alias("_raw"), "freq")
            .unionByName(final.select(F.lit(False).alias("_raw"), "freq")))
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("_raw"), F.col("freq"))), F.lit(0)).cast("long").alias("raw_total_tokens"),
        F.count_if(F.col("_raw")).cast("long").alias("raw_unique_keywords"),
        F.coalesce(F.sum(F.when(~F.col("_raw"), F.col("freq"))), F.lit(0)).cast("long").alias("final_total_tokens"),
        F.count_if(~F.col("_raw")).cast("long").alias("final_unique_keywords"),
    ).withColumn("has_keywords", F.col("final_unique_keywords") > 0)
