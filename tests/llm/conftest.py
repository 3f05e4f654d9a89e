import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, _row string, part string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = text(120), text(30_000)
    edited = base.split()
    edited[60] = "changed"
    texts = [base, base, " ".join(edited), None, "", " \n\t ", "one two", text(49), text(50), long, base.upper(), "a" * 50_000, "é " * 60, text(80) + " " + " ".join(base.split()[:40])]
    rows = [(k, t, "en", "s0" if k % 3 else None, None if t is None else len(t), 7, "x", None) for k, t in enumerate(texts)]
    rows += [rows[0], (None, base, None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(100 + k, base, "en", "s1", len(base), 0, "y", "z") for k in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
