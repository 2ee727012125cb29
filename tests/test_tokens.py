"""Keyword scan (TOK4-TOK7) against a plain sequential scan written from
the rules, on random tagged sequences; and the built-in tagger's regex fast
path against the general scan."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lexaudit.operators import keywords as K
from lexaudit.functions import phrases as P
from lexaudit.operators.tokens import forced_matches, scan_keywords, script_tokens

NOUN = "名詞"


def norm(t):
    s = unicodedata.normalize("NFKC", t or "").strip()
    return re.sub(r"\s+", "", s).lower()


def skip(t):
    if not t or len(t) <= 1:
        return True
    if len(t) <= 2 and re.fullmatch(r"[ぁ-んー]+", t):
        return True
    if all(unicodedata.category(c).startswith("N") for c in t):
        return True
    if all(unicodedata.category(c)[0] in "PS" for c in t):
        return True
    return False


def seq_scan(toks, compound_mode, phrases):
    """toks: list of (surface, base, primary, subtype)."""
    toks = [(s, s if b in ("", "*") else b, p, st) for s, b, p, st in toks]
    phrases = {norm(p) for p in phrases if norm(p)}
    maxlen = max((len(p) for p in phrases), default=0)
    prefixes = {p[:i] for p in phrases for i in range(1, len(p) + 1)}
    ns = [norm(t[0]) for t in toks]
    out, i = [], 0

    def ext(j):
        return toks[j][2] == NOUN and toks[j][3] not in ("数", "非自立", "代名詞") and bool(ns[j])

    while i < len(toks):
        if phrases and ns[i] and ns[i][0] in {p[0] for p in phrases}:
            comb, end, ph = "", None, None
            for j in range(i, len(toks)):
                if not ns[j]:
                    break
                comb += ns[j]
                if len(comb) > maxlen or comb not in prefixes:
                    break
                if comb in phrases:
                    end, ph = j + 1, comb
            if end is not None:
                if not skip(ph):
                    out.append((i, ph))
                i = end
                continue
        if compound_mode and ext(i) and toks[i][3] != "接尾":
            e = i + 1
            while e < len(toks) and ext(e):
                e += 1
            if e - i > 1:
                text = norm("".join(t[0] for t in toks[i:e]))
                if not skip(text):
                    out.append((i, text))
                    i = e
                    continue
        s, b, p, st = toks[i]
        if p == NOUN and st not in ("数", "非自立", "代名詞", "接尾"):
            v = norm(b) or ns[i]
            if not skip(v):
                out.append((i, v))
        i += 1
    return out


WORDS = ["東京", "タワー", "駅", "ab", "x", "1", "データ", "分析", "は", "の", "°", "ー", "Ｐｙ", "3D"]
POS = [(NOUN, "一般"), (NOUN, "一般"), (NOUN, "接尾"), (NOUN, "数"), (NOUN, "非自立"), (NOUN, "代名詞"),
       (NOUN, "固有名詞"), ("助詞", "格助詞"), ("記号", "一般")]


def random_docs(rng, n_docs):
    docs = {}
    for d in range(n_docs):
        toks = []
        for _ in range(rng.randint(0, 25)):
            w = rng.choice(WORDS)
            p, st = rng.choice(POS)
            base = rng.choice([w, "*", ""])
            toks.append((w, base, p, st))
        docs[f"d{d}"] = toks
    return docs


def run_scan(spark, docs, compound_mode, phrases):
    rows = [(k, i, s, b, p, st) for k, toks in docs.items() for i, (s, b, p, st) in enumerate(toks)]
    df = spark.createDataFrame(rows, "doc_key string, pos int, surface string, base_form string, "
                                     "primary_pos string, subtype string")
    out = scan_keywords(df, compound_mode=compound_mode, forced_phrases=[norm(p) for p in phrases])
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_key"], []).append((r["pos"], r["keyword"]))
    return {k: sorted(v) for k, v in got.items()}


def test_scan_random(spark):
    rng = random.Random(5)
    docs = random_docs(rng, 120)
    for compound_mode, phrases in ((True, []), (False, []), (True, ["東京タワー", "データ分析", "駅ab", "タワー駅"]),
                                   (False, ["東京タワー", "ab"])):
        got = run_scan(spark, docs, compound_mode, phrases)
        for k, toks in docs.items():
            exp = seq_scan(toks, compound_mode, phrases)
            assert got.get(k, []) == exp, (k, compound_mode, phrases, toks)


def test_forced_inside_auto_compound_is_swallowed(spark):
    toks = [("データ", "データ", NOUN, "一般"), ("東京", "東京", NOUN, "一般"), ("タワー", "タワー", NOUN, "一般")]
    got = run_scan(spark, {"d": toks}, True, ["東京タワー"])
    assert got["d"] == [(0, "データ東京タワー")]
    got = run_scan(spark, {"d": toks[1:]}, True, ["東京タワー"])
    assert got["d"] == [(0, "東京タワー")]


def test_fast_path_equals_general_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    fast = K.count_occurrences(K.noun_occurrences(docs, "text"))
    toks = script_tokens(docs, "doc_id", "text")
    general = K.count_normalized(scan_keywords(toks, compound_mode=True))
    a = {(r["keyword"], r["freq"]) for r in fast.collect()}
    b = {(r["keyword"], r["freq"]) for r in general.collect()}
    assert a == b
    jp = spark.createDataFrame([(1, "東京タワーは3Dデータ分析の駅前ビル。ｶﾀｶﾅとＡＢＣ123、ひらがな")], "doc_id long, text string")
    fast = {(r["keyword"], r["freq"]) for r in K.count_occurrences(K.noun_occurrences(jp, "text")).collect()}
    general = {(r["keyword"], r["freq"]) for r in
               K.count_normalized(scan_keywords(script_tokens(jp, "doc_id", "text"))).collect()}
    assert fast == general
    assert ("東京タワー", 1) in fast


def longest_plain(ns, phrases):
    out = []
    for i in range(len(ns)):
        best = (0, None)
        for j in range(i, len(ns)):
            if not ns[j]:
                break
            text = "".join(ns[i:j + 1])
            if text in phrases:
                best = (j + 1 - i, text)
        out.append(best)
    return out


def test_automaton_finds_the_longest_phrase_at_each_token():
    rng = random.Random(9)
    for _ in range(400):
        phrases = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12))}
        ns = ["".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.choice((0, 1, 1, 1, 2, 3))))
              for _ in range(rng.randint(0, 30))]
        n, text = P.PhraseAutomaton(sorted(phrases)).longest(ns)
        assert list(zip(n, text)) == longest_plain(ns, phrases), (phrases, ns)


def test_phrases_past_one_automaton_take_further_passes(spark, monkeypatch):
    assert P.phrase_classes(["bb", "a", "", "bb", "ccc"], 3) == [["a", "bb"], ["ccc"]]
    monkeypatch.setattr(P, "PHRASE_CHARS", 5)
    rows = [("d", i, s, s, NOUN, "一般") for i, s in enumerate(["ab", "cd", "", "ab", "cd", "ef", "x"])]
    rows += [("e", 0, None, None, None, None), (None, 0, "ab", "ab", NOUN, "一般"), (None, 1, "cd", "cd", NOUN, "一般")]
    df = spark.createDataFrame(rows, "doc_key string, pos int, surface string, base_form string, "
                                     "primary_pos string, subtype string")
    got = {(r.doc_key, r.pos, r.phrase, r.n_tokens) for r in forced_matches(df, ["abcd", "ab", "cdef", "ef", "xy"]).collect()}
    assert got == {("d", 0, "abcd", 2), ("d", 3, "abcd", 2), ("d", 4, "cdef", 2), ("d", 5, "ef", 1), (None, 0, "abcd", 2)}
    assert forced_matches(df, []).count() == 0 and forced_matches(df.limit(0), ["ab"]).count() == 0


def test_many_phrases_leave_the_plan_as_it_is(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    toks = script_tokens(docs, "doc_id", "text")

    def plan(phrases):
        return scan_keywords(toks, forced_phrases=phrases)._jdf.queryExecution().analyzed().toString()

    many = [f"phrase{k}x" for k in range(100_000)]
    assert abs(len(plan(many)) - len(plan(["thethe"]))) < 2000
    a = sorted(map(tuple, scan_keywords(toks, forced_phrases=["thethe", "theand"]).collect()))
    assert a == sorted(map(tuple, scan_keywords(toks, forced_phrases=["thethe", "theand", *many]).collect()))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_scan_moves_a_document_once_and_has_no_window(spark):
    rows = [(f"d{k % 3}", k, s, "*", NOUN, "一般") for k, s in enumerate(["ab", "cd", "ef", "x", "ab", "cd"])]
    df = spark.createDataFrame(rows, "doc_key string, pos int, surface string, base_form string, "
                                     "primary_pos string, subtype string")
    for phrases in ((), ("abcd",)):
        plan = executed(scan_keywords(df, forced_phrases=phrases))
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


def test_runs_of_a_document_become_one_row():
    import pyarrow as pa

    from lexaudit.functions.scan import document_runs
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", None, None, "b", "a"]), pa.array(range(6))], ["k", "v"])
    (out,) = document_runs([batch])
    assert out.to_pydict() == {"k": ["a", None, "b", "a"], "v": [[0, 1], [2, 3], [4], [5]]}


def test_counts_by_text_move_each_text_once(spark, tmp_path):
    from lexaudit.plans.queries import q_page_token_counts
    rows = [(1, "the Tower and ＡＢＣ Tower"), (1, "of tower"), (None, "x yes"), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q_page_token_counts(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 7, 7, 4), (None, 1, 1, 1)}
    assert executed(q_page_token_counts(spark, str(tmp_path))).count("hashpartitioning") == 1


def test_a_page_batch_is_parsed_a_few_pages_at_a_time():
    import pyarrow as pa

    from lexaudit.functions.batches import SLICE, by_slices
    sizes = []
    double = by_slices(lambda c: sizes.append(len(c)) or pa.array([2 * v for v in c.to_pylist()], pa.int64()), pa.int64())
    assert double(pa.array(range(300))).to_pylist() == list(range(0, 600, 2)) and max(sizes) <= SLICE
    assert double(pa.array([], pa.int64())).to_pylist() == []
