import random

import pytest

SF = "/root/testdata/sf0.001"
# Columns that clash with names the operators use inside.
CLASHING = "shard int, part int, chunk int, size long, score double, row long, n long, cls long, key long, src int, stratum string, words string, label long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def edge_rows():
    """Null, empty, blank, tiny, very long and repeated texts, null ids, tied
    rows, shared passages and copies, on texts of a few words."""
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "délta", "eps!", "zeta", "eta", "theta", "iota", "kappa"]

    def prose(n):
        return " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))

    passage = prose(60)
    base = prose(300)
    near = base.split(" ")
    near[10] = "changed"
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "two words"), (6, "a b c d e"), (7, base),
        (8, base), (9, " ".join(near)), (10, prose(40) + "\n" + passage), (11, passage + "\n" + prose(50)),
        (12, "loser " * 400), (13, "x" * 20_000), (14, prose(6000)), (15, "é" * 120), (16, "é" * 120), (None, base),
        (None, None), (17, prose(30)), (17, prose(30)), (18, "same row"), (18, "same row"), (19, "A B C D E"),
        (20, "line one\nline one\nline two\n\n\nline two"), (21, "### $$$ %%% &&&"), (22, "null\x00byte \x1c sep"),
        (23, "日本語 の テキスト 😀 " * 30), (-5, passage), (24, "<|endoftext|> it's"), (25, base.upper()),
    ]
    return [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "s10", None, ""]), 0, 1, 2, 3, 4, 0.5, 6, 7, 8,
             9, 10, "x", "y", 1) for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
