"""Small tables with the awkward rows that every operator must take."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tests_llm_text import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n_tokens long"


def awkward_rows() -> list[tuple]:
    long = prose(1, 30_000)
    rows = [
        (0, prose(2, 60), "en", "a", 1),
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "de", "b", 4),
        (None, prose(3, 40), "en", "b", 5),
        (None, None, None, None, None),
        (4, prose(2, 60), "en", "c", 1),  # a copy of 0
        (0, prose(2, 60), "en", "a", 1),  # 0 again
        (5, long, "fr", "c", 6),
        (6, "one", "en", "a", 3),
        (7, "Größe ÉCOLE naïve x×y 中文 🙂 l'été fin", "fr", None, 9),
        (8, "a <|endoftext|> b  c\r\nd\x00e ▁ <s>", "en", "b", 9),
        (9, "x" * 5000, "en", "b", 9),
        (10, "!!! ---", "en", "a", 7),
    ]
    return [(*r, 0.5, 3, 1) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def all_null(spark):
    return spark.createDataFrame([(None,) * 8] * 3, SCHEMA)
