"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

from merceris.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(frame):
    def one(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return str(x) if isinstance(x, (str, bool)) else round(float(x), 9) if hasattr(x, "__float__") else str(x)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["Q02", "Q04", "Q10", "Q17", "Q20", "C01", "T07", "T08", "L03", "R01", "DQG1", "EVT2", "PIP3", "PIP4", "CLN2", "KEY1", "A01", "M11", "V09", "RUN3", "SNK3_status", "SNK5_category", "SNK7", "SRC3_status", "DIM1_days", "WHS1", "WHS2", "DQG2", "DQG4_all", "PIP10_all", "RUN1", "RUN2", "EVT1", "FCT4", "Q03", "C09", "R02", "R04", "SNK2_versions", "SRC1_rejected", "SRC7_files", "RUN1_load", "RUN2_load", "C07_kept", "L03_kept", "Q17_cube", "Q18_cube", "V06_cube", "V07_cube", "M17_cube", "V07_rollup", "SNK6_ranges", "A02_served", "A05_served", "V12_served"])
def test_query_equals_its_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SMALL).toPandas()) == plain(duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
