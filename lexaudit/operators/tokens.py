"""Token tables (TOK1) and the general keyword scan over tagged tokens
(TOK2, TOK4-TOK7).

The ``morph_tokens`` contract is ``(doc_key, pos, surface, base_form,
primary_pos, subtype)``. Any tagger can produce it; the built-in one splits
text into script runs.
"""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.functions import scan as S
from lexaudit.functions.phrases import phrase_classes, phrase_steps
from lexaudit.functions.tokens import (TAGGER_RE, compound_extension_ok, compound_start_ok,
                                       script_pos, single_noun_ok, skip_basic_token)
from lexaudit.operators.common import dealt_by


def script_tokens(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """TOK1(b): the built-in script-run tagger. ``posexplode`` keeps the
    token order as data; base form = surface."""
    toks = df.select(F.col(key_col).cast("string").alias("doc_key"),
                     F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")),
                                                       F.lit(TAGGER_RE), 1)).alias("pos", "surface"))
    primary, subtype = script_pos(F.col("surface"))
    return toks.select("doc_key", F.col("pos").cast("int").alias("pos"), "surface",
                       F.col("surface").alias("base_form"),
                       primary.alias("primary_pos"), subtype.alias("subtype"))


def _tokens_of_documents(tokens: DataFrame) -> DataFrame:
    """One row per ``doc_key`` with its tokens as lists of the same length:
    ``_pos``, ``_surface``, ``_base`` (empty where it is the surface) and
    ``_flags`` (what the part of speech allows). One exchange, by document;
    nothing but these four values of a token moves."""
    surface, base = F.coalesce("surface", F.lit("")), F.coalesce("base_form", F.lit(""))
    kind = (F.col("primary_pos"), F.col("subtype"))
    # The surface itself is tested when it has been normalised.
    flags = (F.when(compound_extension_ok(*kind, F.lit("x")), S.EXT).otherwise(0)
             + F.when(compound_start_ok(*kind, F.lit("x")), S.START).otherwise(0)
             + F.when(single_noun_ok(*kind), S.SINGLE).otherwise(0)).cast("tinyint")
    moved = tokens.select("doc_key", F.coalesce("pos", F.lit(-1)).cast("int").alias("_pos"), surface.alias("_surface"),
                          F.when((base == "*") | (base == surface), F.lit("")).otherwise(base).alias("_base"),
                          flags.alias("_flags"))
    # The tokens of a document mostly stand together: each run of them becomes
    # one row before the exchange, and the exchange joins a document's runs.
    names = ("_pos", "_surface", "_base", "_flags")
    key = tokens.schema["doc_key"].dataType.simpleString()
    runs = moved.mapInArrow(S.document_runs, f"doc_key {key}, _pos array<int>, _surface array<string>, "
                                             "_base array<string>, _flags array<tinyint>")
    return dealt_by(runs, "doc_key").groupBy("doc_key").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in names])


def _longest(spark: SparkSession, phrases: Sequence[str]):
    """Function of a document's normalised surfaces -> longest phrase at each
    (its tokens, its text); phrases past the bound of one automaton take
    further passes and the longest match of all passes counts."""
    steps = phrase_steps(spark, phrase_classes(phrases))

    def longest(surfaces: Sequence[str]) -> tuple[list[int], list[str | None]]:
        n, text = [0] * len(surfaces), [None] * len(surfaces)
        for step in steps:
            for i, (k, phrase) in enumerate(zip(*step(surfaces))):
                if k > n[i]:
                    n[i], text[i] = k, phrase
        return n, text

    return steps[0] if len(steps) == 1 else longest


def forced_matches(tokens: DataFrame, forced_phrases: Sequence[str]) -> DataFrame:
    """TOK6: at each position the longest run of normalised surfaces whose
    join is a phrase -> ``(doc_key, pos, phrase, n_tokens)``."""
    longest = _longest(tokens.sparkSession, forced_phrases)

    def matches(pos: pa.Array, surface: pa.Array) -> pa.Array:
        return S.per_document(lambda p, s: S.phrases_at(p, s, longest), S.PHRASES)(pos, surface)

    matches.__annotations__ = {"pos": pa.Array, "surface": pa.Array, "return": pa.Array}
    found = F.arrow_udf(matches, S.PHRASES_DDL).asNondeterministic()
    docs = _tokens_of_documents(tokens.withColumns(dict.fromkeys(
        ("base_form", "primary_pos", "subtype"), F.lit(None).cast("string"))))
    return _unpacked(docs.select("doc_key", found("_pos", "_surface").alias("_found")), "pos", "phrase", "n_tokens")


def _unpacked(found: DataFrame, *names: str) -> DataFrame:
    """One row per place of the lists in ``_found``."""
    rows = found.select("doc_key", F.explode(F.arrays_zip(*[F.col(f"_found.{n}").alias(n) for n in names])).alias("_k"))
    return rows.select("doc_key", F.nullif(F.col("_k.pos"), F.lit(-1)).alias("pos"), *[f"_k.{n}" for n in names if n != "pos"])


def scan_keywords(tokens: DataFrame, *, compound_mode: bool = True,
                  forced_phrases: Sequence[str] = ()) -> DataFrame:
    """TOK4-TOK7 over ``morph_tokens``: left to right, a forced phrase, else
    an auto compound, else a single noun; the scan jumps past what it took.

    Returns ``(doc_key, pos, keyword, kind)``, one row per emitted keyword.

    Plan: one exchange gathers the tokens of a document, the scan
    (``functions/scan.py``) goes over them once, and its keywords come out as
    rows. The plan has the same size for any number of phrases.
    """
    phrases = sorted({p for p in forced_phrases if p})
    longest = _longest(tokens.sparkSession, phrases) if phrases else None

    def keywords(pos: pa.Array, surface: pa.Array, base: pa.Array, flags: pa.Array) -> pa.Array:
        return S.per_document(lambda *lists: S.scan(*lists, longest, compound_mode), S.KEYWORDS)(pos, surface, base, flags)

    keywords.__annotations__ = dict.fromkeys(("pos", "surface", "base", "flags", "return"), pa.Array)
    found = F.arrow_udf(keywords, S.KEYWORDS_DDL).asNondeterministic()
    docs = _tokens_of_documents(tokens).select("doc_key", found("_pos", "_surface", "_base", "_flags").alias("_found"))
    out = _unpacked(docs, "pos", "keyword", "kind")
    return out.filter(F.col("keyword").isNotNull() & ~skip_basic_token(F.col("keyword")))
