import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of the input.
CLASHING = "key long, id long, kept string, score string, bucket string, words string, rest string, runs string, anchor string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choices(pool, k=n))


def edge_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    near = prose(2, 300).split()
    near[150] = "changed"
    return [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (None, prose(3, 60), "en", "a", None),
        (5, long_text, "en", "a", len(long_text)), (6, prose(2, 300), "en", "a", 1), (7, " ".join(near), "en", "a", 1), (8, prose(2, 300), "en", "a", 1),
        (9, prose(4, 40), "de", "b", 1), (9, prose(4, 40), "de", "b", 1), (9, prose(5, 50), "de", "b", 1), (10, "é" * 450, "fr", "b", 450),
        (11, "*** $$$ &&& " * 30, "en", "b", 360), (None, None, None, None, None), (12, "a\xa0b　c <|endoftext|> 日本", "ja", "b", 9), (13, "", "en", "a", 0),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(*r, 1, 2, "x", "x", "x", "x", "x", "x", "x") for r in edge_rows()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
