"""Cleaning steps and the nine dataset pipelines. Steps are lazy and run no action of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The e-mail pattern, the default date window and the allowed values.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
DATES = ("2015-01-01", "2030-12-31")
BIRTHS = ("1930-01-01", "2015-12-31")
CUSTOMER_STATUS = ("active", "inactive", "churned")
ORDER_STATUS = ("completed", "cancelled", "pending", "refunded")
PAYMENT_STATUS = ("success", "failed", "pending", "refunded")
TICKET_STATUS = ("open", "in_progress", "resolved", "closed")
EVENT_TYPES = ("page_view", "search", "product_view", "add_to_cart", "remove_from_cart", "checkout_start", "purchase")


def drop_null_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def deduplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the least by all other columns, nulls last, so the choice is the same on every run.

    A minimum merges in the tasks that read the rows, so of a key on very many rows each task sends one; no task sorts them.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    least = F.min(F.struct(*[f(quoted(c)).alias(f"{kind}{k}") for k, c in enumerate(rest) for kind, f in (("null", F.isnull), ("value", lambda x: x))]))
    found = df.groupBy(*[quoted(c) for c in keys]).agg(least.alias("__least"))
    return found.select(*[quoted(c) if c in keys else F.col(f"__least.value{rest.index(c)}").alias(c) for c in df.columns])


def flag_invalid_email(df: DataFrame, column: str = "email") -> DataFrame:
    good = F.coalesce(F.col(column).rlike(EMAIL), F.lit(False))
    return df.withColumn("is_valid_email", good).withColumn(column, F.when(F.col("is_valid_email"), F.col(column)))


def clip_negative(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) >= 0, F.col(column)))


def keep_dates(df: DataFrame, column: str, window: tuple[str, str] = DATES) -> DataFrame:
    first, last = (F.lit(x).cast("date") for x in window)
    return df.withColumn(column, F.when(F.col(column).cast("date").between(first, last), F.col(column)))


def keep_values(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)))


def split_orphans(facts: DataFrame, parents: DataFrame, key: str, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, the others); a null key is an orphan. ``small`` is for parents of a known small size."""
    known = parents.select(key).where(F.col(key).isNotNull())  # semi and anti joins don't mind repeated keys
    known = F.broadcast(known) if small else known
    return facts.join(known, key, "left_semi"), facts.join(known, key, "left_anti")


def null_cost_over_price(df: DataFrame) -> DataFrame:
    fine = F.coalesce(F.col("cost") <= F.col("selling_price"), F.lit(True))
    return df.select(*[F.when(fine, F.col(c)).alias(c) if c in ("cost", "selling_price") else F.col(c) for c in df.columns])


def stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("_processed_at", F.current_timestamp())


def step_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows before and after, and the share kept, in one pass over each side."""
    a = before.agg(F.count("*").alias("rows_before"), F.count_if(F.col(key).isNull()).alias("null_keys"))
    b = after.agg(F.count("*").alias("rows_after"))
    return a.crossJoin(F.broadcast(b))  # one row each


def clean_customers(raw: DataFrame, dates: tuple[str, str] = DATES) -> DataFrame:
    df = flag_invalid_email(deduplicate(drop_null_key(raw, "customer_id"), ["customer_id"]))
    return keep_values(keep_dates(keep_dates(df, "date_of_birth", BIRTHS), "registration_date", dates), "customer_status", CUSTOMER_STATUS)


def clean_products(raw: DataFrame) -> DataFrame:
    return null_cost_over_price(deduplicate(drop_null_key(raw, "product_id"), ["product_id"]))


def clean_orders(raw: DataFrame, customers: DataFrame) -> DataFrame:
    df = clip_negative(deduplicate(drop_null_key(raw, "order_id"), ["order_id"]), "total_amount")
    return split_orphans(keep_values(df, "order_status", ORDER_STATUS), customers, "customer_id")[0]


def clean_order_items(raw: DataFrame, orders: DataFrame, products: DataFrame, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``stage`` may store the rows between the three steps that move all of them, so that the shuffles of one are on disk at a time."""
    df = stage(clip_negative(deduplicate(drop_null_key(raw, "order_item_id"), ["order_item_id"]), "unit_price"))
    # the order last: its lines then stand together, and their ids take less room in files
    out = split_orphans(stage(split_orphans(df, products, "product_id")[0]), orders, "order_id")[0]
    return out.select("product_id", "order_id", *[c for c in out.columns if c not in ("product_id", "order_id")])


def clean_payments(raw: DataFrame, orders: DataFrame) -> DataFrame:
    df = clip_negative(deduplicate(drop_null_key(raw, "payment_id"), ["payment_id"]), "amount")
    return split_orphans(keep_values(df, "payment_status", PAYMENT_STATUS), orders, "order_id")[0]


def clean_tickets(raw: DataFrame, customers: DataFrame) -> DataFrame:
    df = keep_values(deduplicate(drop_null_key(raw, "ticket_id"), ["ticket_id"]), "status", TICKET_STATUS)
    return split_orphans(df, customers, "customer_id")[0]


def clean_campaigns(raw: DataFrame) -> DataFrame:
    return deduplicate(drop_null_key(raw, "campaign_id"), ["campaign_id"])


def clean_interactions(raw: DataFrame, campaigns: DataFrame, customers: DataFrame) -> DataFrame:
    df = deduplicate(drop_null_key(raw, "interaction_id"), ["interaction_id"])
    return split_orphans(split_orphans(df, campaigns, "campaign_id")[0], customers, "customer_id")[0]


def clean_events(raw: DataFrame, customers: DataFrame) -> DataFrame:
    df = keep_values(deduplicate(drop_null_key(raw, "event_id"), ["event_id"]), "event_type", EVENT_TYPES)
    return split_orphans(df, customers, "customer_id")[0]


def clean_all(raw: dict[str, DataFrame], dates: tuple[str, str] = DATES, store: Callable[[str, DataFrame, str], DataFrame] | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All nine, parents first, and the two event summaries.

    store (name, rows, key) writes a clean table and gives it back as read, so its children don't clean it anew; ``stage`` is that of ``clean_order_items``.
    """
    from .events import session_summary, top_viewed

    out: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame, key: str) -> None:
        out[name] = store(name, df, key) if store is not None else df

    put("customers", clean_customers(raw["customers"], dates), "customer_id")
    put("products", clean_products(raw["products"]), "product_id")
    put("marketing_campaigns", clean_campaigns(raw["marketing_campaigns"]), "campaign_id")
    put("orders", clean_orders(raw["orders"], out["customers"]), "order_id")
    put("order_items", clean_order_items(raw["order_items"], out["orders"], out["products"], stage), "order_item_id")
    put("payments", clean_payments(raw["payments"], out["orders"]), "payment_id")
    put("customer_support", clean_tickets(raw["customer_support"], out["customers"]), "ticket_id")
    put("campaign_interactions", clean_interactions(raw["campaign_interactions"], out["marketing_campaigns"], out["customers"]), "interaction_id")
    put("website_events", clean_events(raw["website_events"], out["customers"]), "event_id")
    put("session_summary", session_summary(out["website_events"]), "session_id")
    put("top_products_daily", top_viewed(out["website_events"]), "product_id")
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
