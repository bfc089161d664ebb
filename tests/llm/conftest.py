import random

import pytest

WORDS = ["the", "of", "and", "tion", "Er", "onth", "reha", "ousted", "hand", "ingly", "a", "été", "straße", "niño", "x9", "It's"]


def prose(rnd, n, vocabulary=400):
    pick = [rnd.choice(WORDS) + (str(i % 7) if i % 3 else "") + rnd.choice(["", "", "er", "ish", "ly"]) for i in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rnd.choice(pick) + str(rnd.randrange(3000)) * (rnd.random() < 0.4) + rnd.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """Documents as (doc_id, text): every awkward case beside ordinary prose, copies, near copies and shared passages."""
    rnd = random.Random(5)
    out = [prose(rnd, rnd.randrange(5, 160)) for _ in range(40)]
    shared = prose(rnd, 45)
    out += [f"{prose(rnd, 12)} {shared} {prose(rnd, 9)}" for _ in range(6)]
    out += [out[3]] * 3 + [out[7].replace(" ", "  "), out[7].upper()]
    base = prose(rnd, 200).split(" ")
    for i in range(8):
        mine = list(base)
        for _ in range(i):
            mine[rnd.randrange(len(mine))] = f"edit{rnd.randrange(999)}"
        out.append(" ".join(mine))
    out += ["", " \n\t ", "one", "two words", "two words", "a b c", "the the the " * 30, "line\n" * 50, "a\x00b\x1c c\u00a0d \u2003e 日本 語 😀 " * 8, prose(rnd, 30_000), None, None]
    rows = [(i * 3, t) for i, t in enumerate(out)]
    rows += [rows[5], rows[5], rows[41]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def items(texts):
    w = texts[10][1].split()
    return [(1, " ".join(w[2:20])), (2, " ".join(w[2:20])), (3, "two words"), (4, ""), (5, None), (None, "one"), (6, texts[12][1]), (6, texts[12][1]), (7, "nowhere to be found at all in any of these long texts")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents, rows without id, and columns whose names operators may use themselves."""
    extra = [(None, texts[3][1]), (None, None), (None, "the the the " * 30)]
    rows = [(d, t, "en", "src0", len(t or ""), 1, "k", 0.5, b"m", 7) for d, t in [*texts, *extra]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, key string, score double, mask binary, kind int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
