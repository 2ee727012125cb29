"""Token-level column expressions: the script-run tagger patterns (TOK1b),
the basic reject rule (TOK3) and the noun eligibility tests (TOK4, TOK5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaudit.functions.text import PY_WS

# Part-of-speech labels and subtype sets of the noun rules.
NOUN = "名詞"
SUFFIX = "接尾"
EXCLUDED_SINGLE_SUBTYPES = ("数", "非自立", "代名詞", "接尾")
EXCLUDED_COMPOUND_SUBTYPES = ("数", "非自立", "代名詞")
HIRAGANA_ONLY_RE = "^[ぁ-んー]+$"

# Script runs of the built-in tagger. Han, Katakana and Latin runs are nouns,
# digit runs are numeral nouns, hiragana runs are particles, white space and
# every other single character are signs.
HAN_RUN = "\\p{IsHan}+"
KATAKANA_RUN = "[\\p{IsKatakana}ー]+"
HIRAGANA_RUN = "\\p{IsHiragana}+"
LATIN_WORD = "\\p{IsLatin}[\\p{IsLatin}\\p{M}-]*"
DIGIT_RUN = "\\p{N}+"
WS_RUN = "[" + PY_WS + "]+"

TAGGER_RE = ("(?s)(" + HAN_RUN + "|" + KATAKANA_RUN + "|" + HIRAGANA_RUN + "|"
             + LATIN_WORD + "|" + DIGIT_RUN + "|" + WS_RUN + "|.)")
# One noun token of the built-in tagger (used when compounds are off).
NOUN_TOKEN_RE = "(" + HAN_RUN + "|" + KATAKANA_RUN + "|" + LATIN_WORD + ")"
# A maximal run of adjacent noun tokens: with the built-in tagger this is
# exactly what the auto-compound rule joins (one token -> single noun).
NOUN_ISLAND_RE = "((?:" + HAN_RUN + "|" + KATAKANA_RUN + "|" + LATIN_WORD + ")+)"


def script_pos(token: Column) -> tuple[Column, Column]:
    """(primary_pos, subtype) of a token of the built-in tagger."""
    primary = (F.when(token.rlike("^(\\p{IsHan}|[\\p{IsKatakana}ー]|\\p{IsLatin}|\\p{N})"), F.lit(NOUN))
               .when(token.rlike("^\\p{IsHiragana}"), F.lit("助詞"))
               .otherwise(F.lit("記号")))
    subtype = (F.when(token.rlike("^\\p{N}"), F.lit("数"))
               .when(token.rlike("^[" + PY_WS + "]"), F.lit("空白"))
               .otherwise(F.lit("一般")))
    return primary, subtype


def skip_basic_token(token: Column) -> Column:
    """TOK3: empty, one character, short hiragana, all numeric, all signs."""
    t = F.coalesce(token, F.lit(""))
    return (
        (F.length(t) <= 1)
        | ((F.length(t) <= 2) & t.rlike(HIRAGANA_ONLY_RE))
        | t.rlike("^\\p{N}+$")
        | t.rlike("^[\\p{P}\\p{S}]+$")
    )


def is_noun(primary_pos: Column) -> Column:
    return F.coalesce(primary_pos == F.lit(NOUN), F.lit(False))


def single_noun_ok(primary_pos: Column, subtype: Column) -> Column:
    """TOK4 POS test."""
    return is_noun(primary_pos) & ~F.coalesce(subtype, F.lit("")).isin(*EXCLUDED_SINGLE_SUBTYPES)


def compound_extension_ok(primary_pos: Column, subtype: Column, norm_surface: Column) -> Column:
    """TOK5: a noun that may continue an auto compound."""
    return (is_noun(primary_pos)
            & ~F.coalesce(subtype, F.lit("")).isin(*EXCLUDED_COMPOUND_SUBTYPES)
            & (F.coalesce(norm_surface, F.lit("")) != F.lit("")))


def compound_start_ok(primary_pos: Column, subtype: Column, norm_surface: Column) -> Column:
    """TOK5: a noun that may start an auto compound (extension, not suffix)."""
    return compound_extension_ok(primary_pos, subtype, norm_surface) & (
        F.coalesce(subtype, F.lit("")) != F.lit(SUFFIX))
