"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""

import random

import pytest

CLASHES = "key string, body string, cls long, n long, score double, uid long, h long, row string, passes int, component long, __text string, __key long, gram long"


def words(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(60)]
    return " ".join(r.choice(pool) for _ in range(n))


def awkward_rows():
    base = words(1, 60)
    near = base.split()
    near[-1] = "changed"
    long = words(2, 30_000)
    texts = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one"), (8, "one two three"), (9, long), (10, long + " end"), (11, "Ünï çödé 漢字 🙂 password=hunter2xyz"), (None, base), (None, None), (12, words(3, 40)), (12, words(3, 40)), (13, words(4, 40)), (13, words(5, 40)), (14, "TOKEN: 'abcdef' " + "0123456789abcdef" * 2), (15, "AKIA" + "A" * 16 + " x" * 50)]
    return [(k, t, "en", None if k in (3, 8) else f"s{(k or 0) % 3}", len(t or ""), *(["x", "y"] + [1, 2, 0.5, 3, 4, "z", 5, 6, "w", 7, 8])) for k, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")
