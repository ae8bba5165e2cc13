import glob
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skarn.session import build_session  # noqa: E402

DATA = os.environ.get("SKARN_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores=4, shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    """Rows as sorted text, columns by name, floats to nine places."""

    def cell(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 9))
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "isoformat") else str(v)

    df = df[sorted(df.columns)]
    return sorted("|".join(map(cell, r)) for r in df.itertuples(index=False, name=None))
