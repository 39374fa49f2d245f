from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docquarry.session import build

    session = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def same_rows(got, want) -> None:
    """Two pandas frames with the same rows in any order, columns by name."""
    assert sorted(got.columns) == sorted(want.columns)
    import pandas as pd

    names = sorted(got.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else (int(v) if isinstance(v, float) and v.is_integer() else v)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(got) == rows(want)
