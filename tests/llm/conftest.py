import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from lexispark.plans.catalog import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and repeated rows, ties, a long text, and extra columns with names that operators use themselves."""
    line = "the quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion tonight"
    rows = [
        (1, line, "en"), (2, line, "en"), (2, line, "en"), (3, None, None), (4, "", "de"), (5, "  \n \t", "de"),
        (6, "word", "fr"), (None, line + " again", None), (7, line + "\n" + line + "\nother words here", "es"),
        (8, " ".join(f"w{i % 997}" for i in range(20_000)), "en"), (9, "aé日\U0001f600 \x00 b", "en"), (6, "another text for the same id", "en"),
    ]
    rows = [(i, t, lang, "src", len(t) if t else 0, 5, 1, "x", 2) for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key int, words string, line int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")
