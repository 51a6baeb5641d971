"""Small tables with the awkward cases every operator must define a result for."""

import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"

PROSE = "the quick brown fox jumps over the lazy dog while the old cat sleeps under a warm red blanket near the quiet fire"


def rows():
    texts = [
        PROSE, PROSE, PROSE.replace("cat", "dog"), PROSE.upper(), "  " + PROSE + "\n", PROSE.replace(" ", "  "), "", None, " ", "\t\n", "one",
        "one two", "Ünïcödé wörds ÀÉ don't <|endoftext|> 123 4.5!?", "a b c d e " * 3000, "x" * 50_000, PROSE + " " + PROSE, "line\nline\n\nline",
    ]
    out = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    out.append((3, PROSE.upper(), "en", "src3", 111))  # a repeated doc_id and text
    out.append((None, PROSE, "en", "src1", 5))
    out.append((None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """Every row of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def clashing(df):
    """The same with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "row kept bucket guest sha content file start n_tokens ids score length shard keep_id _id size rank leaf token component line"
    return df.select("*", *[F.lit("x").alias(n) for n in names.split()])


@pytest.fixture(scope="session")
def clash():
    return clashing
