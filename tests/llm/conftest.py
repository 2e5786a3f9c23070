from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

#: Columns besides those of documents, named like columns that operators use on their way.
EXTRA = "key long, node string, bucket int, keep_id string, kept string, ref long, size string, target int, copies long, score double, chunk int, ids string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, null and repeated ids."""
    plain = "the quick brown fox jumps over the lazy dog again and again until the night falls"
    texts = [
        (1, plain, "a"),
        (2, plain, "b"),
        (2, plain, "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \n\t ", None),
        (None, plain, "a"),
        (None, None, None),
        (6, LONG, "c"),
        (7, LONG, "c"),
        (8, "short", "c"),
        (8, "other", "c"),
        (9, "naïve 漢字 🎉 <|endoftext|> it's we'll  two   blanks", "d"),
    ]
    return [(i, t, "en" if i != 5 else None, s, None, *[None] * 12) for i, t, s in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_rows(df: pd.DataFrame) -> list[tuple]:
    def shown(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "null"
        if isinstance(x, (float, np.floating)):
            return f"{x:.6f}".removesuffix(".000000")
        return str(x)

    return sorted(tuple(shown(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows():
    def check(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert plain_rows(ours) == plain_rows(theirs)

    return check
