"""The data-quality registry.

All 23 checks together come from one key index: each dataset is read once for it, its rows say what they know about their own key
and their parents' keys, and all later steps read what was stored of that. Keys that nothing refers to, those of order lines, are
not in it; their repeats are counted from that one column. A few checks alone are asked of their datasets.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merceris.functions.storage import scratch

from .clean import CUSTOMER_STATUS, EMAIL, ORDER_STATUS

THRESHOLD = 0.95

#: Id, dataset, name, dimension, critical.
CHECKS = (
    ("DQ01", "customers", "customer_id is not null", "completeness", True),
    ("DQ02", "customers", "email is not null", "completeness", True),
    ("DQ03", "orders", "order_id is not null", "completeness", True),
    ("DQ04", "orders", "customer_id is not null", "completeness", True),
    ("DQ05", "order_items", "product_id is not null", "completeness", True),
    ("DQ06", "customers", "customer_id is unique", "uniqueness", True),
    ("DQ07", "orders", "order_id is unique", "uniqueness", True),
    ("DQ08", "order_items", "order_item_id is unique", "uniqueness", True),
    ("DQ09", "customers", "email is well formed", "validity", True),
    ("DQ10", "customers", "customer_status is known", "validity", True),
    ("DQ11", "orders", "order_status is known", "validity", True),
    ("DQ12", "orders", "total_amount is not negative", "validity", True),
    ("DQ13", "order_items", "unit_price is not negative", "validity", True),
    ("DQ14", "payments", "amount is not negative", "validity", True),
    ("DQ15", "products", "cost is not over selling_price", "accuracy", True),
    ("DQ16", "orders", "total_amount is the sum of its lines", "accuracy", False),
    ("DQ17", "orders", "customer exists", "referential_integrity", True),
    ("DQ18", "order_items", "product exists", "referential_integrity", True),
    ("DQ19", "order_items", "order exists", "referential_integrity", True),
    ("DQ20", "payments", "order exists", "referential_integrity", True),
    ("DQ21", "website_events", "customer exists", "referential_integrity", True),
    ("DQ22", "campaign_interactions", "campaign exists", "referential_integrity", True),
    ("DQ23", "payments", "amount is the order's total", "consistency", False),
)

#: Foreign key checks as id, child, key, parent.
PARENTS = (("DQ17", "orders", "customer_id", "customers"), ("DQ18", "order_items", "product_id", "products"), ("DQ19", "order_items", "order_id", "orders"), ("DQ20", "payments", "order_id", "orders"), ("DQ21", "website_events", "customer_id", "customers"), ("DQ22", "campaign_interactions", "campaign_id", "marketing_campaigns"))


#: Uniqueness checks as id, dataset, key.
UNIQUE = (("DQ06", "customers", "customer_id"), ("DQ07", "orders", "order_id"), ("DQ08", "order_items", "order_item_id"))

#: Own keys of the datasets that are parents. Lines have none here, as nothing names them: see ``repeated``.
_OWN = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "marketing_campaigns": "campaign_id"}
_KINDS = list(_OWN)
_SIDES = list(dict.fromkeys([*_OWN, *(p[1] for p in PARENTS)]))
#: Who names a key, as one small number: whose key it is, and above the lowest three bits of that.
_SIDE_BITS = 3


def _who(kind: str, side: str) -> int:
    return (_KINDS.index(kind) << _SIDE_BITS) + _SIDES.index(side)


def _names(side: str) -> list[tuple[str, str]]:
    """(kind, column) of the keys that a dataset's rows name; each of its rows is counted and checked under the first."""
    own = [(side, _OWN[side])] if side in _OWN else []
    return own + [(parent, key) for _, child, key, parent in PARENTS if child == side]


def _fails(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _faults() -> dict[str, dict[str, Column]]:
    """What makes a row fail each check that needs no other row."""
    null = lambda c: F.col(c).isNull()
    unknown = lambda c, known: F.col(c).isNull() | ~F.col(c).isin(*known)
    return {
        "customers": {"DQ01": null("customer_id"), "DQ02": null("email"), "DQ09": F.col("email").isNull() | ~F.col("email").rlike(EMAIL), "DQ10": unknown("customer_status", CUSTOMER_STATUS)},
        "orders": {"DQ03": null("order_id"), "DQ04": null("customer_id"), "DQ11": unknown("order_status", ORDER_STATUS), "DQ12": F.col("total_amount") < 0},
        "order_items": {"DQ05": null("product_id"), "DQ13": F.col("unit_price") < 0},
        "payments": {"DQ14": F.col("amount") < 0},
        "products": {"DQ15": F.col("cost") > F.col("selling_price")},
    }


def _simple() -> dict[str, dict[str, Column]]:
    checks = {dataset: {name: _fails(bad) for name, bad in faults.items()} for dataset, faults in _faults().items()}
    for name, dataset, key in UNIQUE:
        checks[dataset][name] = F.greatest(F.count(key) - F.count_distinct(F.col(key)), F.lit(0))
    return checks


def _line_amount() -> Column:
    return F.col("quantity") * F.col("unit_price") * (1 - F.coalesce("discount", F.lit(0)))


def _total_is_off(total: str, lines: str) -> Column:
    return F.abs(F.coalesce(total, F.lit(0)) - F.coalesce(lines, F.lit(0))) > 1


def _payment_is_off(amount: str, total: str) -> Column:
    return F.abs(F.col(amount) - F.col(total)) > F.lit("0.01").cast("decimal(3,2)")


def _orphans(tables: dict[str, DataFrame], check: str, child: str, key: str, parent: str) -> DataFrame:
    known = tables[parent].select(F.col(key).alias("__known")).where("__known is not null").distinct()
    joined = tables[child].select(key).join(known, F.col(key) == F.col("__known"), "left")
    return joined.agg(F.count("*").alias("total"), _fails(F.col(key).isNotNull() & F.col("__known").isNull()).alias("failed")).select(F.lit(check).alias("check_id"), "total", "failed")


def _line_sums(tables: dict[str, DataFrame]) -> DataFrame:
    sums = tables["order_items"].groupBy("order_id").agg(F.sum(_line_amount()).alias("lines"))
    off = _total_is_off("total_amount", "lines")
    return tables["orders"].join(sums, "order_id", "left").agg(F.count("*").alias("total"), _fails(off).alias("failed")).select(F.lit("DQ16").alias("check_id"), "total", "failed")


def _paid(tables: dict[str, DataFrame]) -> DataFrame:
    off = _payment_is_off("amount", "total_amount")
    pairs = tables["payments"].select("order_id", "amount").join(tables["orders"].select("order_id", "total_amount"), "order_id")
    return pairs.agg(F.count("*").alias("total"), _fails(off).alias("failed")).select(F.lit("DQ23").alias("check_id"), "total", "failed")


def key_index(tables: dict[str, DataFrame]) -> DataFrame:
    """One scan of each dataset: rows by (who, key, amount, faults), where ``who`` is whose key it is and who names it.

    n counts rows; ``faults`` has a bit for each check of its own that they fail, ``lines`` sums the line amounts of an order.
    Amounts of orders and payments are told apart by value, so that no list of a key is ever collected; equal rows,
    null keys among them, are merged before the shuffle. Rows are kept narrow and only keys that others name are in it,
    since the tasks that read the lines hold all their keys at once.
    """
    parts = []
    for dataset in _SIDES:
        bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(_faults().get(dataset, {}).values())]
        records = []
        for at, (kind, key) in enumerate(_names(dataset)):
            amount = {"orders": "total_amount", "payments": "amount"}.get(dataset) if kind == "orders" else None
            fields = {
                "who": F.lit(_who(kind, dataset)), "key": F.col(key).cast("string"), "amount": F.col(amount) if amount else F.lit(None),
                "faults": sum(bits, F.lit(0)) if at == 0 else F.lit(0), "line": _line_amount() if (kind, dataset) == ("orders", "order_items") else F.lit(None),
            }
            records.append(F.struct(*[c.alias(name) for name, c in fields.items()]))
        parts.append(tables[dataset].select(F.explode(F.array(*records)).alias("r")).select("r.*"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("who", "key", "amount", "faults").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys on more than one row."""
    keys = df.select(F.col(key).cast("string").alias("key")).where("key is not null")
    return keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _from_index(index: DataFrame, again: dict[str, DataFrame]) -> DataFrame:
    """(check_id, total, failed) of all checks from a stored ``key_index`` and the stored repeated keys of checks that it hasn't; total is null where it is the dataset's number of rows."""
    first = {d: _who(_names(d)[0][0], d) for d in _SIDES}
    failed = lambda k: F.sum(F.when(F.col("faults").bitwiseAND(1 << k) != 0, F.col("n")))
    rows_of = index.where(F.col("who").isin(*first.values())).groupBy("who").agg(F.sum("n").alias("total"), *[failed(k).alias(f"f{k}") for k in range(max(map(len, _faults().values())))])
    own = [F.when(F.col("who") == first[d], F.array(*[F.struct(F.lit(name).alias("check_id"), F.col(f"f{k}").alias("failed")) for k, name in enumerate(faults)])) for d, faults in _faults().items()]
    nothing = F.lit(None).cast("long").alias("total")
    found = rows_of.select(F.explode(F.coalesce(*own)).alias("c")).select("c.check_id", nothing, "c.failed")

    by = lambda kind, side: F.sum(F.when(F.col("who") == _who(kind, side), F.col("n")))
    known = F.sum(F.when(F.col("who").isin(*[_who(k, k) for k in _KINDS]), F.col("n")))
    named = [by(parent, child).alias(check) for check, child, _, parent in PARENTS]
    keys = index.where("key is not null").groupBy(F.shiftright("who", _SIDE_BITS).alias("kind"), "key").agg(F.coalesce(known, F.lit(0)).alias("known"), *named)
    lost = [F.sum(F.when(F.col("known") == 0, F.col(p[0]))).alias(p[0]) for p in PARENTS]
    twice = {check: dataset for check, dataset, _ in UNIQUE if check not in again}
    more = [F.sum(F.when((F.col("kind") == _KINDS.index(d)) & (F.col("known") > 1), F.col("known") - 1)).alias(check) for check, d in twice.items()]
    checks = [*(p[0] for p in PARENTS), *twice]
    parts = [keys.agg(*lost, *more).selectExpr(f"stack({len(checks)}, " + ", ".join(f"'{c}', {c}" for c in checks) + ") as (check_id, failed)").select("check_id", nothing, "failed")]
    parts += [df.agg(F.sum(F.col("n") - 1).alias("failed")).select(F.lit(check).alias("check_id"), nothing, "failed") for check, df in again.items()]

    of_orders = lambda side: index.where(F.col("who") == _who("orders", side))
    orders = of_orders("orders").select("key", F.col("amount").alias("total"), F.col("n").alias("orders"))
    lines = of_orders("order_items").select("key", "lines")  # an order has one row
    sums = orders.join(lines, "key", "left").agg(F.sum(F.when(_total_is_off("total", "lines"), F.col("orders"))).alias("failed"))
    pairs = orders.join(of_orders("payments").select("key", F.col("amount").alias("paid"), F.col("n").alias("payments")), "key").withColumn("n", F.col("orders") * F.col("payments"))
    paid = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.sum(F.when(_payment_is_off("paid", "total"), F.col("n"))).alias("failed"))
    parts += [sums.select(F.lit("DQ16").alias("check_id"), nothing, "failed"), paid.select(F.lit("DQ23").alias("check_id"), "total", "failed")]
    for part in parts:
        found = found.unionByName(part)
    names = F.element_at(F.create_map(*[F.lit(x) for d, who in first.items() for x in (who, d)]), F.col("who"))
    of_dataset = rows_of.select(names.alias("dataset"), F.col("total").alias("rows"))  # eight rows
    out = _registry(index).join(F.broadcast(found), "check_id", "left").join(F.broadcast(of_dataset), "dataset", "left")
    return out.select("check_id", F.coalesce("total", "rows", F.lit(0)).alias("total"), F.coalesce("failed", F.lit(0)).alias("failed"))


def _direct(tables: dict[str, DataFrame], wanted: set[str]) -> DataFrame:
    """(check_id, total, failed) of some checks, reading only what they need."""
    parts = []
    for dataset, every in _simple().items():
        checks = {name: c for name, c in every.items() if name in wanted}
        if not checks:
            continue
        row = tables[dataset].agg(F.count("*").alias("total"), *[c.alias(name) for name, c in checks.items()])
        stack = ", ".join(f"'{name}', {name}" for name in checks)
        parts.append(row.selectExpr("total", f"stack({len(checks)}, {stack}) as (check_id, failed)").select("check_id", "total", "failed"))
    parts += [_orphans(tables, *p) for p in PARENTS if p[0] in wanted]
    parts += [check(tables) for name, check in (("DQ16", _line_sums), ("DQ23", _paid)) if name in wanted]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _registry(df: DataFrame) -> DataFrame:
    quoted = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return df.sparkSession.sql("select * from values " + ", ".join("(" + ", ".join(map(quoted, c)) + ")" for c in CHECKS) + " as t(check_id, dataset, check_name, dimension, critical)")


def results(tables: dict[str, DataFrame], threshold: float = THRESHOLD, only: Collection[str] | None = None) -> DataFrame:
    """All 23 checks, or ``only`` some: check_id, dataset, check_name, dimension, critical, total, failed, pass_rate, status.

    pass_rate is rounded to 4 places and 1 for an empty dataset. For all checks the key index is stored first; for some,
    what the others need is not read.
    """
    if only is None:
        index = key_index(tables)
        path = scratch(index.sparkSession)
        index.write.parquet(f"{path}/index")
        stored = {check: f"{path}/{check}" for check, dataset, _ in UNIQUE if dataset not in _OWN}
        for check, dataset, key in UNIQUE:
            if check in stored:
                repeated(tables[dataset], key).write.parquet(stored[check])
        found = _from_index(index.sparkSession.read.schema(index.schema).parquet(f"{path}/index"), {check: index.sparkSession.read.schema("key string, n long").parquet(p) for check, p in stored.items()})
    else:
        found = _direct(tables, set(only))
    found = found.join(F.broadcast(_registry(found)), "check_id")
    rate = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.round((F.col("total") - F.col("failed")) / F.col("total"), 4))
    found = found.withColumn("pass_rate", rate)
    return found.select("check_id", "dataset", "check_name", "dimension", "critical", "total", "failed", "pass_rate", F.when(F.col("pass_rate") >= threshold, "PASS").otherwise("FAIL").alias("status"))


def gate(found: DataFrame) -> DataFrame:
    """One row: checks, failed critical checks, and whether the batch passes."""
    bad = F.count_if(F.col("critical") & (F.col("status") == "FAIL"))
    return found.agg(F.count("*").alias("checks"), bad.alias("critical_failures"), F.when(bad == 0, "PASS").otherwise("FAIL").alias("overall"))


def summary(found: DataFrame) -> DataFrame:
    """The status of each check beside that of the batch."""
    bad = F.count_if(F.col("critical") & (F.col("status") == "FAIL")).over(Window.partitionBy())  # a row a check
    return found.select("check_id", "status", F.when(bad == 0, "PASS").otherwise("FAIL").alias("overall"))


def by_dimension(found: DataFrame) -> DataFrame:
    return found.groupBy("dimension").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"), F.sum("failed").alias("failed_records"))


def report(found: DataFrame) -> DataFrame:
    """The whole result as one JSON document."""
    columns = ("check_id", "dataset", "dimension", "critical", "total", "failed", "status")
    each = F.array_sort(F.collect_list(F.struct(*columns)))
    return found.agg(F.to_json(F.struct(F.count("*").alias("checks"), F.count_if(F.col("status") == "FAIL").alias("failed_checks"), each.alias("results"))).alias("report"))
