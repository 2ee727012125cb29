"""op6 and op7: against the tokenizers library and a plain greedy match."""

import hashlib
import random
import struct
import sys
import weakref

from lexaudit.llm.bpe import Codec, encode, op7_bpe
from lexaudit.llm.kept import kept
from lexaudit.llm.token_counts import Automaton, count_tokens, op6_token_counts
from lexaudit.llm.vocab import CHUNK, PIECE, WORD_END, Vocabulary, byte_chars, default_path, normalize
from tests_llm_support import SF
from tokenizers import Tokenizer

ALPHABET = "abcABCéèÉÀß ΣσΟΔΟΣ İİé<|endoftext|> '’s't'RE 1٣½ \x85\xa0 　\x1c\x1f\x00​漢字かなカ가각😀#$%||~\t\n\r"


def library(text):
    t = Tokenizer.from_file(default_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)


def test_codec_equals_the_library():
    rnd = random.Random(1)
    codec = Codec(Vocabulary.read(default_path()))
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for text in [*texts, "x" * 3000, "ab" * 700 + " " + "é" * 400, "", "It's they'll we'd I'M", "a<|endoftext|>b <|startoftext|>"]:
        n, ids, decoded = codec.text(text)
        assert (ids, decoded) == library(text) and n == len(ids) // 4


def test_short_and_long_words_merge_alike():
    rnd = random.Random(2)
    codec = Codec(Vocabulary.read(default_path()))
    for _ in range(200):
        raw = "".join(rnd.choice("theanisorx") for _ in range(rnd.randint(1, 60))).encode()
        parts = [*(codec.inner[b] for b in raw[:-1]), codec.last[raw[-1]]]
        assert codec.scan(list(parts)) == codec.queue(list(parts))


def test_documents_and_edge_cases(spark, edge, empty):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), edge):
        want = sorted(((r.doc_id or 0, *library(r.text)) for r in df.collect()))
        got = sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in encode(df).collect())
        assert got == want
    assert encode(empty).count() == 0
    row = op7_bpe(spark, SF).orderBy("doc_id").first()
    ids, text = library(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first().text)
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
        len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def greedy(ids, piece):
    chars = [byte_chars()[b] for b in piece.encode()]
    at = n = 0
    while at < len(chars):
        for to in range(len(chars), at, -1):
            if "".join(chars[at:to]) + (WORD_END if to == len(chars) else "") in ids:
                break
        else:
            return 1
        at, n = to, n + 1
    return n


def test_automaton_equals_greedy_matching(spark, edge, empty):
    vocab = Vocabulary.read(default_path())
    for df in (spark.read.parquet(f"{SF}/documents.parquet").limit(60), edge):
        for r in df.select("doc_id", "text").collect():
            if len(r.text or "") > 8000:
                continue
            pieces = [p for c in CHUNK.findall(r.text or "") for p in PIECE.findall(normalize(c))]
            assert Automaton.text(_automaton(vocab), r.text) == sum(greedy(vocab.ids, p) for p in pieces)
    assert count_tokens(edge).count() == edge.count()
    assert count_tokens(empty).count() == 0
    assert op6_token_counts(spark, SF).count() == 200


_made = []


def _automaton(vocab):
    if not _made:
        _made.append(Automaton(vocab))
    return _made[0]


def test_automaton_with_a_gap_in_the_vocabulary():
    small = Automaton(Vocabulary({"a": 0, "ab": 1, "abcd": 2, "b": 3, "c</w>": 4, "d</w>": 5, "c": 6, "b</w>": 7}, []))
    assert small.word("abc") == 2      # ab, c</w>
    assert small.word("abcd") == 3     # abcd is no word end: ab, c, d</w>
    assert small.word("abcdab") == 3   # abcd, a, b</w>
    assert small.word("xyz") == 1      # unknown


def test_a_worker_keeps_one_object_with_its_caches():
    class Held:
        pass

    first = kept(-1, Held)
    assert kept(-1, Held) is first
    gone = weakref.ref(first)
    del first
    kept(-2, Held)   # as the next operator of a pipeline does in the same worker
    assert gone() is None


def test_a_cached_chunk_is_its_ids_alone():
    codec = Codec(Vocabulary.read(default_path()))
    for k in range(300):
        codec.text(f"Word{k}, word{k} wording")
    assert len(codec.chunks) == 601 and len(codec.words) > 10
    held = [*codec.chunks.values(), *codec.words.values()]
    assert all(type(x) is bytes and len(x) % 4 == 0 for x in held)
    assert sum(map(sys.getsizeof, held)) < 64 * len(held)
