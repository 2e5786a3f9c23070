"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from oddsloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(df):
    def shown(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "null"
        if isinstance(x, (float, np.floating)):
            return f"{x + 0.0:.6f}".replace("-0.000000", "0.000000")
        return str(x)

    return sorted(tuple(shown(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    ours, theirs = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for c in ours.columns:  # dates and integers may come as other types of the same values
        if "datetime" in str(theirs[c].dtype):
            ours[c] = pd.to_datetime(ours[c]).astype(theirs[c].dtype)
        elif theirs[c].isna().any() and pd.api.types.is_numeric_dtype(theirs[c]):
            ours[c], theirs[c] = ours[c].astype("float64"), theirs[c].astype("float64")
    assert rows(ours) == rows(theirs)
