import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, shard string, "
          "score string, word string, bucket string, h string, n string, point string, pos string")


def frame(spark, rows):
    """A document table with extra columns whose names the operators use inside; rows are (doc_id, text[, lang])."""
    full = []
    for r in rows:
        i, text, lang = (*r, None)[:3]
        full.append((i, text, lang, None, None if text is None else len(text), *["x"] * 9))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tabflow.session import ship_package
    ship_package(spark)


BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, equal texts, ties and a null id."""
    long_text = " ".join(f"{BASE[i % 19]}{i % 257}" for i in range(30_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, " ".join(BASE)), (4, " ".join(BASE)), (5, " ".join(BASE)),
            (6, " ".join(BASE[:15] + ["other", "end"])), (None, " ".join(BASE)), (7, "x"), (8, "Ünïcode ΑΒΓ 日本語 😀"),
            (9, long_text), (10, long_text + " tail"), (11, "one two three"), (12, "ONE two three"), (13, "...!!!")]
