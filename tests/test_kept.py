"""Gold tables kept batch by batch against those built from everything at once."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from merceris.plans import kept
from merceris.plans.gold import Gold
from merceris.sources.adapter import Tables

CUTS = (("a", None, "1995-06-01"), ("b", "1995-06-01", "2024-01-10"), ("c", "2024-01-10", None))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


class One(kept.Batch):
    """A batch that brings new orders of one customer."""

    def orders(self):
        some = self.whole.orders().where("order_status = 'completed'").orderBy("customer_id", "order_id").limit(1)
        return some.withColumn("order_id", F.concat(F.lit("new"), "order_id")).withColumn("total_amount", F.lit(1234.5).cast("decimal(14,2)"))

    def website_events(self):
        return self.whole.website_events().limit(0)

    def customer_support(self):
        return self.whole.customer_support().limit(0)

    def campaign_interactions(self):
        return self.whole.campaign_interactions().limit(0)


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    out = kept.KeptStates(spark, f"file://{tmp_path_factory.mktemp('states')}")
    tables = Tables(spark, SMALL)
    for batch, first, end in (*CUTS, CUTS[1]):  # one batch is loaded again
        out.add(batch, kept.Batch(tables, first, end))
    return out


def test_merged_states_are_those_of_everything(spark, states):
    for name, whole in kept.batch_states(Gold(Tables(spark, SMALL))).items():
        assert rows(states.state(name)) == rows(kept.merged(name, whole))


def test_gold_tables_from_states(spark, states):
    own, whole = kept.KeptGold(states, Tables(spark, SMALL)), Gold(Tables(spark, SMALL))
    for table in ("base_profile", "rfm", "monthly", "cohort", "clv"):
        assert rows(getattr(own, table)) == rows(getattr(whole, table)), table


def test_a_session_over_two_batches_counts_once(spark, tmp_path):
    states = kept.KeptStates(spark, f"file://{tmp_path}")
    for batch, n in (("1", 2), ("2", 3)):
        part = spark.createDataFrame([("c", "s", n), ("c", None, 1)], kept.COLUMNS["sessions"]).withColumn("bucket", F.lit(0))
        part.write.partitionBy("bucket").parquet(f"{states.root}/sessions/batch={batch}")
    assert [tuple(r) for r in kept.KeptGold(states, Tables(spark, SMALL)).web_stats().collect()] == [("c", 1, 7)]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    tables = Tables(spark, SMALL)
    states, path = kept.KeptStates(spark, f"file://{tmp_path}/states"), f"{tmp_path}/profile"
    for batch, first, end in CUTS:
        states.add(batch, kept.Batch(tables, first, end))
    assert kept.refresh_profile(states, tables, f"file://{path}", "c") == list(range(kept.BUCKETS))
    before, old = files(path), {r["customer_id"]: r for r in spark.read.parquet(path).collect()}
    states.add("d", One(tables, None, None))
    touched = kept.refresh_profile(states, tables, f"file://{path}", "d")
    assert len(touched) == 1
    gone, came = before - files(path), files(path) - before
    assert gone and came and all(f"bucket={touched[0]}/" in f for f in gone | came)
    new = {r["customer_id"]: r for r in spark.read.parquet(path).collect()}
    changed = [c for c in new if new[c] != old[c]]
    assert new.keys() == old.keys() and len(changed) == 1
    assert new[changed[0]]["completed_orders"] == old[changed[0]]["completed_orders"] + 1 and new[changed[0]]["spend"] == old[changed[0]]["spend"] + 123_450
    assert rows(spark.read.parquet(path).drop("bucket")) == rows(kept.KeptGold(states, tables).base_profile)


def test_reading_one_bucket_prunes_folders(states):
    plan = states.state("orders", [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_only_named_states_are_stored(spark, tmp_path):
    tables = Tables(spark, SMALL)
    states = kept.KeptStates(spark, f"file://{tmp_path}")
    for batch, first, end in CUTS:
        states.add(batch, kept.Batch(tables, first, end), ["orders"])
    assert os.listdir(tmp_path) == ["orders"]
    assert rows(kept.KeptGold(states, tables).clv) == rows(Gold(tables).clv)


def test_counts_of_products_are_dealt_as_they_are_stored(spark):
    plan = kept.batch_states(Gold(Tables(spark, SMALL)))["products"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(customer_id" not in plan
