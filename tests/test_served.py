"""Look-ups over stored tables: the rows of those over everything, and what is pruned and pushed down."""

from __future__ import annotations

import pytest
from conftest import SMALL

from merceris.plans import lookup, measures, served
from merceris.plans.gold import Gold
from merceris.sources.adapter import Tables

ALL = ("CUST00000007", "CUST00000100", "nobody")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('served')}"
    served.store(Gold(Tables(spark, SMALL)), path, buckets=16)
    return path


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("look", [lookup.customer, lookup.customer_orders, lookup.customer_top_products, lookup.device_counts, lookup.customer_recent_events, measures.customer_page])
def test_same_rows_as_over_everything(spark, root, look):
    whole = Gold(Tables(spark, SMALL))
    for who in ALL[::2]:
        assert rows(look(served.Customer(spark, root, who, buckets=16), who)) == rows(look(whole, who)), who


def test_few_files_are_read(spark, root):
    for name in served.NAMES:
        own = served.Customer(spark, root, ALL[0], buckets=16).rows(name)
        run = own._jdf.queryExecution()
        run.toRdd().count()
        scan = run.executedPlan().collectLeaves().head()
        assert scan.metrics().get("numFiles").get().value() <= served.FILES < 16 < len(own.inputFiles()), name
        plan = run.executedPlan().toString()
        pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
        assert f"EqualTo(customer_id,{ALL[0]})" in pushed
        assert own.count() == spark.read.parquet(f"{root}/{name}").where(f"customer_id = '{ALL[0]}'").count()


def test_a_profile_reads_the_orders_once_more_for_its_lines_only(spark):
    plan = Gold(Tables(spark, SMALL)).profile_view()._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{SMALL}/orders.parquet") == 1
