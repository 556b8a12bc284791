from __future__ import annotations

import random

import pytest

WORDS = "der the und and ist of in to eine maison está année größe été niño data spark row plan node key sum join".split()


def make_text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Documents with nulls, empties, exact and near copies, shared passages, a long text, ties and repeated rows."""
    rng = random.Random(3)
    base = make_text(rng, 120)
    passage = make_text(rng, 70)
    rows: list[tuple[int | None, str | None]] = [(0, base), (1, base), (2, base.replace(" ", "\n ")), (3, base.replace("der", "DER")), (4, base + " tail"), (5, None), (6, ""), (7, " \t\n"), (8, "é"), (9, "ab"), (None, base), (None, "only null"), (10, "a" * 200), (10, "a" * 200), (11, "ß" * 120), (12, "😀 astral " * 9)]
    rows += [(20 + i, f"{make_text(rng, 40 + i)} {passage} {make_text(rng, 30)}") for i in range(6)]
    rows += [(30 + i, make_text(rng, rng.randint(1, 90))) for i in range(30)]
    words = base.split()
    for i in range(5):
        words = [*words]
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 - i, " ".join(words)))
    rows.append((200, make_text(rng, 12_000)))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those documents, with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, "x", 1, "k") for d, t in texts], "doc_id long, text string, key string, size int, data string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")
