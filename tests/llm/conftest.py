import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, score string"


def prose(seed: int, n: int, letters: str = "abcdefg") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(n))


def near(text: str, at: int) -> str:
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


def document_rows() -> list[tuple]:
    """Copies, near copies, a shared passage, long, empty and null texts, ties, repeated rows and ids."""
    base, passage = prose(1, 120), prose(2, 60)
    texts = [base, base.upper(), near(base, 5), near(base, 110), near(near(base, 30), 80)]
    texts += [f"{passage} {prose(10 + i, 30)}" for i in range(8)]
    texts += [prose(3, 6000), "", " \t\n", "one two three", "One two  three", None, "x", "é ß İ \x1c 한국어 ½"]
    texts += [f'{prose(40, 20)} password="{"a1" * 5}" and AKIA{"Q7" * 9} end', f"{'0a1b2c3d' * 4} 'Zx8Kq2Lm9Pw4Rt6Yb3Nv'"]
    texts += [prose(50 + i, 40, "hijklmn") for i in range(12)] + ["junk!! " * 30] * 3
    rows = [
        (i, t, ("en", "fr", None)[i % 3] if i % 7 else "en", (None, "a", "b", "a")[i % 4], len(t or ""), "extra", "extra")
        for i, t in enumerate(texts)
    ]
    return [*rows, rows[0], (None, base, "en", "a", 3, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(document_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
