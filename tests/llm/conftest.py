import random

import pytest

from ..conftest import SF_SMALL  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns under names that operators use inside.
CLASH = ("chunk_id", "body", "key", "range", "size", "label", "words", "host", "kept", "seed", "token", "v", "bucket", "n", "a", "b")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, exact and near copies, shared passages, ties, odd characters."""
    rng = random.Random(5)
    out = [(None, None, None, None, None), (1, None, "en", "s0", None), (2, "", "en", "s0", 0), (None, prose(rng, 60), "en", None, 1),
           (3, "one", None, None, 3), (3, "one", None, None, 3), (4, "a b", "fr", "s1", 3), (5, "Ünï cödé \x0b tab\tx\n\nx\n x  y", "de", "s1", 9),
           (6, "the " * 300, "en", "s2", 1200), (7, "x" * 1500, "en", "s2", 1500), (8, prose(rng, 20_000), "en", "s0", 1)]
    base, passage = prose(rng, 200), prose(rng, 80)
    out += [(10 + k, base, "en", "s0", 1) for k in range(5)]
    for k in range(8):  # near copies: a word or two changed
        w = base.split()
        for _ in range(1 + k % 3):
            w[rng.randrange(len(w))] = f"edit{k}{rng.randrange(99)}"
        out.append((20 + k, " ".join(w), "en", "s1", 1))
    out += [(40 + k, f"{prose(rng, 90 + k)} {passage} {prose(rng, 70)}", "en", f"s{k % 3}", 1) for k in range(6)]
    out += [(60 + k, prose(rng, 120), "fr", "s3", 1) for k in range(6)]
    out.append((60, prose(rng, 40), "fr", "s3", 1))  # an id twice, with another text
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
