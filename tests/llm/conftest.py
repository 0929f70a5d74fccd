import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, row string, digest string, tag long, kept string"


def prose(rng: random.Random, words: int) -> str:
    parts = ["the", "of", "and", "ta", "ri", "no", "shel", "ver", "mon", "qua", "lith", "é", "sur", "que"]
    out = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words)]
    return "".join(w + ("\n" if rng.random() < 0.05 else ". " if rng.random() < 0.1 else " ") for w in out).strip()


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = "x" + str(rng.randint(0, 999))
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, ties, nulls, emptiness and great length; clashing columns."""
    rng = random.Random(5)
    texts: list[str | None] = [prose(rng, rng.randint(5, 400)) for _ in range(40)]
    passage, base = prose(rng, 120), prose(rng, 300)
    texts += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60) for _ in range(6)]
    texts += [base, base] + [edited(rng, base, 0.01) for _ in range(6)] + [edited(rng, base, 0.2)]
    texts += [None, None, "", "", " \n\t ", "a", "word " * 300, "A" * 2500, "#$%& " * 200, "short text here", "É" * 3, "12 34 !!", prose(rng, 9000), "abc" * 400 + "\nx"]
    out = [(i, t, rng.choice(["en", "fr", None]), "src", None if t is None else len(t), "p", "r", "d", 7, "k") for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, texts[4], None, None, None, None, None, None, None, None))
    out.append((None, "a text of a row without an id", None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
