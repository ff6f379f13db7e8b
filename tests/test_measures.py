"""The cohort matrix over all periods."""

from __future__ import annotations

from conftest import SMALL
from pyspark.sql import functions as F
from test_registry import duck, plain  # noqa: F401

from merceris.plans import catalog, measures
from merceris.plans.gold import Gold
from merceris.sources.adapter import Tables


def test_whole_cohort_matrix_holds_every_cell(spark, duck):  # noqa: F811
    g = Gold(Tables(spark, SMALL))
    found = measures.whole_cohort_matrix(g)
    cells = found.unpivot(["cohort_month", "first_period"], [f"m{k}" for k in range(12)], "name", "rate").where("rate is not null")
    mine = cells.select("cohort_month", (F.col("first_period") + F.substring("name", 2, 2).cast("long")).alias("period_number"), "rate")
    want = g.cohort.select(F.col("cohort_month").cast("string"), "period_number", "retention_rate")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect()))
    assert mine.agg(F.max("period_number")).first()[0] >= 12
    assert plain(found.toPandas()) == plain(duck.execute(catalog.ORACLES["V04_all"]).df())
