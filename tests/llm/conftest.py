import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed=3, n=60):
    """Random texts with exact copies, near copies, shared passages, short, empty and null ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(300)]
    words = lambda k: r.choices(vocabulary, k=k)
    passage, base = words(30), words(80)
    out = []
    for i in range(n):
        kind = r.randrange(9)
        w = words(r.randint(0, 120))
        if kind == 0 and out:
            out.append(r.choice(out))
            continue
        if kind in (1, 2):
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 10) : r.randint(15, 30)]
        if kind in (3, 4, 5):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        if kind == 6:
            w = words(r.randint(0, 6))
        text = "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w)
        out.append(text.upper() if r.random() < 0.1 else text)
    out += ["", None, " \n ", "x", passage and " ".join(passage), "Ä ä Ä"]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s", "s", "s", "t", None]), len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def odd(spark):
    """Null ids, nulls in all columns, repeated rows, and columns with names the operators use themselves."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, None, None, None, "a", 1), (1, text, None, None, None, "a", 1), (None, text, None, None, None, None, None), (2, None, None, None, None, None, 2), (3, text + " more", "en", "s", 1, "b", 3)]
    return spark.createDataFrame(rows, DOCS + ", score string, __id int")
