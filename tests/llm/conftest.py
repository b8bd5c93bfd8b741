import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, id long, key string, t1 long, component long, kept boolean, value long, likely boolean"


def make_texts() -> list[tuple]:
    """Rows of ``(doc_id, text)``: prose with copies, near copies and shared passages, and the cases at the edges."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.06 else "") for _ in range(n))
    passage = prose(110)
    rows = [(100 + i, prose(rng.choice([12, 40, 90, 200]))) for i in range(30)]
    rows += [(200 + i, prose(30) + " " + passage + " " + prose(25)) for i in range(12)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 20, 4)]
    for i in range(8):  # near copies: a word changed here and there
        words = rows[3 if len(rows[3][1]) > 600 else 7][1].split(" ")
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((400 + i, " ".join(words)))
    base = "The quick brown fox jumps over the lazy dog while many other animals of the wood look on and wonder 12"
    rows += [(500, base + "\n" + base.replace("12", "77")), (501, base.upper() + "!!"), (502, base.replace("wonder", "wander")), (503, "x " * 60)]
    rows += [(600, None), (601, ""), (602, " \t\n\x0b "), (603, "one two"), (604, "One  two"), (605, "\n\n"), (606, "a b ▁c▁ <s> 😀 \x00 x"), (607, passage)]
    rows += [(700, prose(3000)), (701, "z" * 5000), (702, "z" * 5000)]
    rows += [(800, rows[5][1]), (800, rows[5][1]), (None, rows[2][1]), (None, "a text of its own without any identifier at all")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", len(t or ""), 1, 2, 3, "k", 4, 5, True, 6, False) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def result():
    """Rows of a frame in an order that nulls allow."""

    def sorted_rows(rows) -> list[tuple]:
        plain = [tuple(list(x) if isinstance(x, (list, tuple)) else x for x in r) for r in (rows.collect() if hasattr(rows, "collect") else rows)]
        return sorted(plain, key=repr)

    return sorted_rows
