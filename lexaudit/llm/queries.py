"""The registered queries of this subpackage. SQL of those that it can express
is in ``oracle.py``; hash rings, permutations, models and suffix sorting are
tested against brute force or by their invariants in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexaudit.llm.bpe import op7_bpe
from lexaudit.llm.collocations import op13_collocations
from lexaudit.llm.embedding_dedup import op8_embedding_dedup
from lexaudit.llm.lm import op10_lm_scoring
from lexaudit.llm.mixing import op4_mixing
from lexaudit.llm.ngram_join import op3_ngram_join
from lexaudit.llm.oracle import ORACLE  # noqa: F401 - read by the driver contract
from lexaudit.llm.pieces import op11_pieces
from lexaudit.llm.quality import op5_quality
from lexaudit.llm.sharding import op2_sharding
from lexaudit.llm.spelling import op12_spelling
from lexaudit.llm.suffix_dedup import op9_suffix_dedup
from lexaudit.llm.token_counts import op6_token_counts
from lexaudit.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_ngram_join": op3_ngram_join,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_pieces": op11_pieces,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}
