"""The load of the star schema: every table names the tables it needs, and is built once from the stored others."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merceris.operators import star

Built = dict[str, DataFrame]


@dataclass(frozen=True)
class Table:
    """A table of the warehouse. needs: sources or other tables; key: a column that should not be null."""

    needs: tuple[str, ...]
    build: Callable[[Built], DataFrame]
    key: str


def _calendar(t: Built) -> DataFrame:
    """Every day from the first to the last of any fact."""
    moments = {"orders": "order_date", "payments": "payment_date", "website_events": "event_timestamp", "customer_support": "created_at", "campaign_interactions": "interaction_timestamp"}
    ends = [t[name].agg(F.min(c).cast("date").alias("a"), F.max(c).cast("date").alias("z")) for name, c in moments.items()]
    whole = reduce(DataFrame.unionByName, ends).agg(F.min("a").alias("a"), F.max("z").alias("z")).where("a is not null")
    return star.date_columns(whole.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("full_date")))


def _devices(t: Built) -> DataFrame:
    return star.dim_device(t["website_events"].sparkSession)


#: Six dimensions and six facts. The order of the entries doesn't matter.
PLAN: dict[str, Table] = {
    "dim_date": Table(("orders", "payments", "website_events", "customer_support", "campaign_interactions"), _calendar, "date_key"),
    "dim_location": Table(("customers",), lambda t: star.dim_location(t["customers"]), "location_key"),
    "dim_device": Table(("website_events",), _devices, "device_key"),
    "dim_customer": Table(("customers", "dim_location"), lambda t: star.dim_customer(t["customers"], t["dim_location"]), "customer_key"),
    "dim_product": Table(("products",), lambda t: star.dim_product(t["products"]), "product_key"),
    "dim_campaign": Table(("marketing_campaigns",), lambda t: star.dim_campaign(t["marketing_campaigns"]), "campaign_key"),
    "fact_orders": Table(("orders", "dim_customer"), lambda t: star.fact_orders(t["orders"], t["dim_customer"]), "customer_key"),
    "fact_order_items": Table(("order_items", "fact_orders", "dim_product"), lambda t: star.fact_order_items(t["order_items"], t["fact_orders"], t["dim_product"]), "product_key"),
    "fact_payments": Table(("payments", "fact_orders"), lambda t: star.fact_payments(t["payments"], t["fact_orders"]), "order_key"),
    "fact_support_tickets": Table(("customer_support", "dim_customer"), lambda t: star.fact_tickets(t["customer_support"], t["dim_customer"]), "customer_key"),
    "fact_campaign_interactions": Table(("campaign_interactions", "dim_campaign", "dim_customer"), lambda t: star.fact_interactions(t["campaign_interactions"], t["dim_campaign"], t["dim_customer"]), "campaign_key"),
    "fact_website_events": Table(("website_events", "dim_customer", "dim_product", "dim_device"), lambda t: star.fact_events(t["website_events"], t["dim_customer"], t["dim_product"], t["dim_device"]), "customer_key"),
}


def load_order(plan: dict[str, Table], sources: Iterable[str], wanted: Iterable[str] | None = None) -> list[str]:
    """Tables in an order in which each comes after those it needs; with ``wanted`` only these and what they need.

    A cycle, a need that is neither a table nor a source, and a wanted table that isn't in the plan are errors.
    """
    known = set(sources)
    reach, open_ = set(), list(plan if wanted is None else wanted)
    while open_:
        name = open_.pop()
        if name in reach or name in known:
            continue
        if name not in plan:
            raise ValueError(f"{name} is neither a table of the plan nor a source")
        reach.add(name)
        open_ += plan[name].needs
    try:
        order = TopologicalSorter({name: [n for n in plan[name].needs if n in reach] for name in sorted(reach)}).static_order()
        return list(order)
    except CycleError as cycle:
        raise ValueError("tables need each other: " + " <- ".join(cycle.args[1])) from None


def load(sources: Built, store: Callable[[str, DataFrame, str], DataFrame], plan: dict[str, Table] = PLAN, wanted: Iterable[str] | None = None) -> Built:
    """Build and store the plan's tables. ``store`` (name, rows, key column) writes a table and gives it back as read.

    Every table is written once; those that need it read what was written, so no lineage reaches further than one table.
    """
    built: Built = {}
    for name in load_order(plan, sources, wanted):
        given = {n: built[n] if n in built else sources[n] for n in plan[name].needs}
        built[name] = store(name, plan[name].build(given), plan[name].key)
    return built
