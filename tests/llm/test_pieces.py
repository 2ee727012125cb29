"""op11: against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lexaudit.llm.pieces import Codec, Model, decode, default_path, encode, op11_pieces
from tests_llm_support import SF

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=default_path())


@pytest.fixture(scope="module")
def codec():
    with open(default_path(), "rb") as f:
        return Codec(Model(f.read()))


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_random_texts_equal_the_library(codec):
    rnd = random.Random(1)
    signs = [" ", "  ", "   ", "▁", "\n", "\t", "\r", "\x00", "a", "the", "er", "in", "S", "é", "ß", "中", "文", "𝒳", "0", "==",
             "...", "</s>", "<0x41>", "﻿", "—", " " * 9]
    names = [p.replace("▁", " ") for p in codec.model.ids]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 6))) for _ in range(3000)]
    texts += [c * k for c in " a=-_x中𝒳" for k in (1, 2, 3, 7, 31, 64, 501)] + [" " * k + "the" + " " * k for k in range(40)]
    for text in texts:
        raw, decoded = codec.encode(text)
        assert ids_of(raw) == LIBRARY.encode(text), text
        assert decoded == codec.decode(ids_of(raw)) == LIBRARY.decode(LIBRARY.encode(text)), text


def test_laying_pieces_equals_merging(codec):
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice("theanisor.▁") for _ in range(rnd.randint(1, 40)))
        assert codec.pieces(text) == codec.merge(text)


def test_decode_any_ids(spark, codec):
    rnd = random.Random(3)
    rows = [(k, [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(3, 259) for _ in range(rnd.randint(0, 12))])
            for k in range(300)] + [(300, None), (301, []), (302, [1, 2]), (303, [0, 28705, 13])]
    got = {r.doc_id: r.text for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {k: LIBRARY.decode(ids or []) for k, ids in rows}


def test_a_small_cache_gives_the_same(codec, monkeypatch):
    monkeypatch.setattr("lexaudit.llm.pieces.CACHE", 3)
    small = Codec(codec.model)
    for text in ("the cat the dog the cat the bird the cat a b c d e f", "é 中 𝒳 é 中 𝒳 one two one"):
        assert ids_of(small.encode(text)[0]) == LIBRARY.encode(text) and len(small.late) <= 3


def test_other_kinds_of_model_are_refused():
    with pytest.raises(ValueError):
        Model(b"")


def test_documents_and_edge_cases(spark, edge, empty):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), edge):
        want = sorted((r.doc_id or 0, ids := LIBRARY.encode(r.text or ""), LIBRARY.decode(ids)) for r in df.collect())
        assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in encode(df).collect()) == want
    assert encode(empty).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in op11_pieces(spark, SF).collect():
        ids = LIBRARY.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
