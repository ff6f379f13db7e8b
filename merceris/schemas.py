"""Explicit schemas of the nine raw datasets. All columns may be null; bad values are read as null."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Dataset, its columns, its key, the file format of its raw files.
DATASETS = {
    "customers": ("customer_id string, first_name string, last_name string, email string, phone string, gender string, date_of_birth date, city string, province string, country string, registration_date date, customer_status string", "customer_id", "csv"),
    "products": ("product_id string, product_name string, category string, subcategory string, brand string, cost double, selling_price double", "product_id", "csv"),
    "orders": ("order_id string, customer_id string, order_date timestamp, order_status string, payment_method string, total_amount double", "order_id", "csv"),
    "order_items": ("order_item_id string, order_id string, product_id string, quantity int, unit_price double, discount double", "order_item_id", "csv"),
    "payments": ("payment_id string, order_id string, payment_date timestamp, payment_method string, payment_status string, amount double", "payment_id", "csv"),
    "website_events": ("event_id string, customer_id string, session_id string, event_timestamp timestamp, event_type string, page string, product_id string, device string, traffic_source string", "event_id", "json"),
    "customer_support": ("ticket_id string, customer_id string, created_at timestamp, issue_type string, priority string, status string, resolution_time double", "ticket_id", "csv"),
    "marketing_campaigns": ("campaign_id string, campaign_name string, channel string, start_date date, end_date date, budget double", "campaign_id", "csv"),
    "campaign_interactions": ("interaction_id string, campaign_id string, customer_id string, interaction_type string, interaction_timestamp timestamp", "interaction_id", "csv"),
}


def schema(dataset: str) -> StructType:
    return StructType.fromDDL(DATASETS[dataset][0])


def key(dataset: str) -> str:
    return DATASETS[dataset][1]
