import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import random  # noqa: E402

import pytest  # noqa: E402

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names the operators use inside
    "row string, whole string, kept boolean, score double, _score double, word long, bin int, "
    "mark string, _id int, _spans string, size int, n int"
)
EXTRA = ("r", "w", True, 0.5, 0.1, 7, 1, "m", 3, "s", 4, 5)


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with further columns of awkward names."""

    def make(rows):
        out = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "s0")[len(r) - 2 :])
            out.append((doc_id, text, lang, source, None if text is None else len(text), *EXTRA))
        return spark.createDataFrame(out, SCHEMA)

    return make


@pytest.fixture
def words():
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 8))) for _ in range(800)]

    def text(n, seed):
        own = random.Random(seed)
        out = own.choices(pool, k=n)
        return "".join(w + own.choice([" ", " ", " ", "\n", ". "]) for w in out)

    return text


LONG = "lorem ipsum dolor " * 9000
EDGES = [
    (0, None), (1, ""), (2, " \n\t\x0b "), (3, "one"), (4, "Two Words"), (5, LONG), (6, "Two words"),
    (6, "Two words"), (None, "no id here"), (7, "über ünï \U0001f600 ok", None, None), (8, "1 2 3 --"),
]


@pytest.fixture
def edges(docs):
    return docs(EDGES)


@pytest.fixture
def nothing(docs):
    return docs([])
