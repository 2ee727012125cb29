"""op3: components against all pairs, the pigeonhole bound, edge cases."""

import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
from lexaudit.llm import ngram_join as nj
from lexaudit.llm.packing import pack, unpack
from lexaudit.session import cut_lineage
from tests_llm_support import SF, lower, words


def shingles(text):
    w = words(lower(text))
    return ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """(doc_id, text) rows: size and smallest reachable id, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    at = defaultdict(list)
    parent = {i: i for i, _ in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        common = Counter(j for g in s for j in at[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            at[g].append(k)
    return sorted((i is None, i or 0, len(s), find(i) if i is not None and s else i or 0) for i, s in sets)


def check(df):
    want = components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in nj.similar_documents(df).collect())
    assert got == want


def test_documents_and_edge_cases(spark, edge, empty):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    check(edge)
    assert nj.similar_documents(empty).count() == 0


def test_near_copies_chains_and_common_lines(spark):
    """Groups right around the threshold, chains of edits, short texts, and a
    line that a third of all texts share."""
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    rows = []

    def add(ws):
        rows.append((len(rows), " ".join(ws)))

    for n in (5, 6, 7, 8, 9, 10, 12, 20, 40, 90):
        base = [rnd.choice(vocab) for _ in range(n)]
        add(base)
        for edits in (1, 1, 2, 3, 5):
            ws = list(base)
            for _ in range(max(1, n * edits // 60)):
                ws[rnd.randrange(n)] = rnd.choice(vocab)
            add(ws)
        for cut in (1, 2, n // 8):
            add(base[cut:])
            add(base + [rnd.choice(vocab) for _ in range(cut)])
    chain = [rnd.choice(vocab) for _ in range(80)]
    for k in range(12):
        chain = list(chain)
        chain[6 * k] = "step"
        add(chain)
    for _ in range(60):
        add("this is the line that all of these texts have".split() + [rnd.choice(vocab) for _ in range(rnd.randint(3, 40))])
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_differing_parts_never_exceed_the_difference():
    rnd = random.Random(3)
    for _ in range(40):
        n = rnd.randint(4, 300)
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(list(a)[rnd.randint(0, n // 6):]) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 6))}
        band = np.array([int(np.searchsorted(nj.EDGES, min(len(a), len(b)), side="right")) - 1] * 2)
        values = np.array([*sorted(a), *sorted(b)], np.uint64)
        owner, key, _ = nj.sketch_keys(values, np.array([0, len(a), len(a) + len(b)]), np.array([1, 2]), band)
        plain = key < nj._EMPTY
        one, two = (set(key[(owner == k) & plain].tolist()) for k in (0, 1))
        parts = int(nj.part_count(band)[0])
        agree = len(one & two) + parts - len(one | two)
        assert parts - agree <= 2 * len(a ^ b)
        if len(a & b) * 10 >= 8 * len(a | b):
            assert len(a ^ b) <= int(nj.reach(band)[0]) < parts and one & two


def test_sets_whose_parts_are_mostly_empty():
    """Many sets of one shingle per part and fewer: all their parts are keys."""
    rnd = random.Random(12)
    sets = [sorted(rnd.getrandbits(64) for _ in range(n)) for n in (4, 5, 6, 7, 8, 9) for _ in range(200)]
    starts = np.cumsum([0, *map(len, sets)])
    band = np.searchsorted(nj.EDGES, np.diff(starts), side="right") - 1
    owner, key, filled = nj.sketch_keys(np.array(sum(sets, []), np.uint64), starts, np.arange(len(sets)), band)
    poor = filled < np.minimum(np.diff(starts) // 4, nj.reach(band)) + 1
    assert poor.sum() > 1
    each = np.bincount(owner, minlength=len(sets))
    assert (each == np.where(poor, nj.part_count(band), filled)).all()


def test_one_of_each_keeps_columns_and_rows(edge):
    kept = nj.one_of_each(edge)
    ids = sorted(r.doc_id for r in kept.filter("doc_id is not null").collect())
    assert kept.columns == edge.columns and 8 not in ids and 9 not in ids and 7 in ids and {1, 2, 3} <= set(ids)
    assert kept.filter("doc_id is null").count() == 2


def test_near_copies_from_different_chunks(spark, monkeypatch):
    """Every chunk sends several keys a part; the copies of a text lie in
    different chunks and share no more than they must."""
    monkeypatch.setattr(nj, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(nj, "PART_BYTES", 40_000)
    rnd = random.Random(21)
    bases = [[f"w{rnd.randrange(100_000)}" for _ in range(rnd.randint(30, 250))] for _ in range(60)]
    rows = []
    for copy in range(3):
        for base in bases:
            ws = list(base)
            for _ in range(copy * len(ws) // 90):
                ws[rnd.randrange(len(ws))] = f"x{rnd.randrange(100_000)}"
            rows.append((len(rows), " ".join(ws)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_keys_of_64_bits_come_back_from_a_message():
    rnd = np.random.default_rng(5)
    for kind in (np.uint64, np.int64, np.float64, np.int32):
        values = (rnd.random(1000) * 2.0 ** 31).astype(kind)
        back = unpack(pack(values), kind)
        assert back.dtype == kind and (back == values).all()
    assert (unpack(pack(np.array([2**64 - 1, 0, 1 << 47], np.uint64)), np.uint64) == np.array([2**64 - 1, 0, 1 << 47], np.uint64)).all()


def test_shuffle_files_go_with_each_checkpoint(spark):
    """The files of a checkpointed step do not stay beside those of the next."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffle_files():
        return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    before = shuffle_files()
    step = cut_lineage(spark.range(5000).selectExpr("id % 100 as k").groupBy("k").count())
    until = time.time() + 20  # executors remove them on their own time
    while shuffle_files() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files() - before
    assert sorted(map(tuple, step.collect())) == [(k, 50) for k in range(100)]
