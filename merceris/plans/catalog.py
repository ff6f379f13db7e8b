"""Every registered query, by its survey id, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merceris import schemas
from merceris.functions.columns import bucket, date_key, money
from merceris.functions.storage import scratch
from merceris.operators import clean, dirt, events, quality, ranking, star
from merceris.plans import cube, kept, lookup, measures, reports, retail, runlog, served, warehouse
from merceris.plans.gold import Gold
from merceris.plans.oracle import AS_OF, EMAIL, b, day, half_up, pct, sql, sql_cleaned, usd
from merceris.sources import io, ranges, versions
from merceris.sources.adapter import Tables

FLAGSHIP = "Q02"
#: The test tables' sign-ups begin before the default date window.
DATES = ("1990-01-01", "2030-12-31")
BATCH = "2024-02-01"
ONE = "CUST00000007"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[Gold], DataFrame], body: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: build(Gold(Tables(spark, folder)))
    if body is not None:
        ORACLES[name] = sql(body)


def _dirty(g: Gold) -> dict[str, DataFrame]:
    return dirt.dirty_tables(g.tables)


def _clean(g: Gold) -> dict[str, DataFrame]:
    return clean.clean_all(_dirty(g), DATES)


def _plain(df: DataFrame) -> DataFrame:
    """Comparable columns: money as doubles, dates as text, moments as microseconds, whole numbers as bigint."""
    kinds: dict[str, Callable[[Column], Column]] = {"decimal": lambda c: c.cast("double"), "date": lambda c: c.cast("string"), "timestamp": F.unix_micros, "int": lambda c: c.cast("long"), "short": lambda c: c.cast("long")}

    def one(name: str, kind: str) -> Column:
        for start, change in kinds.items():
            if kind.startswith(start):
                return change(F.col(name)).alias(name)
        return F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


#: Columns of each dataset in the SQL's plain form.
_D = lambda c: f"cast({c} as double) {c}"
_T = lambda c: f"cast({c} as varchar) {c}"
_U = lambda c: f"epoch_us({c}) {c}"
_I = lambda c: f"cast({c} as bigint) {c}"
SHAPES = {
    "customers": f"customer_id, first_name, last_name, email, gender, {_T('date_of_birth')}, city, province, country, {_T('registration_date')}, customer_status",
    "products": f"product_id, product_name, category, subcategory, brand, {_D('cost')}, {_D('selling_price')}",
    "orders": f"order_id, customer_id, {_U('order_date')}, order_status, payment_method, {_D('total_amount')}",
    "order_items": f"order_item_id, order_id, product_id, {_I('quantity')}, {_D('unit_price')}, {_D('discount')}",
    "payments": f"payment_id, order_id, {_U('payment_date')}, payment_method, payment_status, {_D('amount')}",
    "website_events": f"event_id, customer_id, session_id, {_U('event_timestamp')}, event_type, product_id, device, traffic_source",
    "customer_support": f"ticket_id, customer_id, {_U('created_at')}, issue_type, priority, status, {_D('resolution_time')}",
    "marketing_campaigns": f"campaign_id, campaign_name, channel, {_T('start_date')}, {_T('end_date')}, {_D('budget')}",
    "campaign_interactions": f"interaction_id, campaign_id, customer_id, interaction_type, {_U('interaction_timestamp')}",
}
DIRTY = {"customers": "x_customers", "products": "x_products", "orders": "x_orders", "order_items": "x_items", "payments": "x_payments", "website_events": "x_events", "customer_support": "x_tickets", "marketing_campaigns": "d_campaigns", "campaign_interactions": "x_touches"}
CLEAN = {k: v.replace("x_", "k_") for k, v in DIRTY.items()}


def _shape(name: str, source: str) -> str:
    return f"select {SHAPES[name]} from {source}"


def _orders(g: Gold) -> DataFrame:
    return g.tables.orders()


# sources and sinks: written to the shared folder and read back


def _raw_csv(g: Gold) -> DataFrame:
    path = scratch(g.tables.spark)
    g.tables.orders().write.option("header", True).csv(path)
    return io.read_raw(g.tables.spark, path, "orders")


def _raw_json(g: Gold) -> DataFrame:
    path = scratch(g.tables.spark)
    _dirty(g)["website_events"].write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return io.read_raw(g.tables.spark, path, "website_events").drop("page")


def _batches(g: Gold) -> str:
    root = scratch(g.tables.spark)
    for shift, batch in ((0, "2024-02-01"), (1, "2024-02-02")):
        part = _orders(g).where(F.substring("order_id", -1, 1).cast("int") % 2 == shift)
        io.write_processed(part, io.folder(root, "processed", "orders", batch), files=2)
    return root


def _replaced(g: Gold) -> DataFrame:
    path = scratch(g.tables.spark)
    rows = _orders(g).select("order_id", F.lit("2024-02-01").alias("batch_date"))
    io.replace_batches(rows.unionByName(_orders(g).select("order_id", F.lit("2024-02-02").alias("batch_date"))), path)
    io.replace_batches(rows.where(F.col("order_id") < "ORD00000100"), path)
    return g.tables.spark.read.parquet(path).groupBy(F.col("batch_date").cast("string").alias("batch_date")).agg(F.count("*").alias("rows"))


def _replaced_by_status(g: Gold) -> DataFrame:
    """Batches are order statuses; a second load brings the completed orders only, with other amounts, and replaces just that batch."""
    path = scratch(g.tables.spark)
    rows = _orders(g).select("order_id", F.col("total_amount").cast("double").alias("total_amount"), F.col("order_status").alias("batch"))
    io.replace_batches(rows, path, "batch")
    io.replace_batches(rows.where("batch = 'completed'").withColumn("total_amount", F.lit(0.0)), path, "batch")
    return g.tables.spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("rows"), F.count_if(F.col("total_amount") == 0).alias("zeros"))


def _status_batch(g: Gold, status: str) -> DataFrame:
    root = scratch(g.tables.spark)
    io.write_processed(_orders(g), io.folder(root, "processed", "orders"), ("order_status",))
    return g.tables.spark.read.parquet(io.folder(root, "processed", "orders")).where(F.col("order_status") == status)


def _kept_results(g: Gold) -> DataFrame:
    """Results of two batches are stored; the second load of the later batch replaces it."""
    path = scratch(g.tables.spark)
    found = quality.results(_dirty(g)).select("check_id", F.when(F.col("total") > 0, F.col("pass_rate")).alias("pass_rate"))
    found = _stored(g, found)
    for batch in ("2024-01-31", BATCH, BATCH):
        io.replace_batches(found.withColumn("batch_date", F.lit(batch)), path)
    kept = g.tables.spark.read.parquet(path).withColumn("batch_date", F.col("batch_date").cast("string"))
    return kept.where(F.col("batch_date") == BATCH).select("check_id", "batch_date", "pass_rate")


def _stored(g: Gold, df: DataFrame) -> DataFrame:
    path = scratch(g.tables.spark)
    df.write.parquet(path)
    return g.tables.spark.read.parquet(path)


def _sources(g: Gold) -> dict[str, DataFrame]:
    return {name: getattr(g.tables, name)() for name in DIRTY}


def _star(g: Gold, wanted: list[str] | None = None) -> dict[str, DataFrame]:
    built = warehouse.load(_sources(g), lambda name, df, key: _stored(g, df), wanted=wanted)
    return built if wanted is None else {n: built[n] for n in wanted}


def _recorded(g: Gold) -> str:
    """Where the log of a load of all twelve tables is: run ``first`` fails at the events, tries them again and is closed, run ``second`` loads two tables."""
    spark, root = g.tables.spark, scratch(g.tables.spark)
    first = runlog.Recorder(spark, f"{root}/log", "first")
    broken = _sources(g)["website_events"].withColumn("customer_key", F.when(F.col("event_id") >= 0, F.raise_error(F.lit("no space left"))).cast("long"))
    try:
        first.write("fact_website_events", broken, "customer_key", f"{root}/fact_website_events")
    except Exception as failed:
        if "no space left" not in str(failed):
            raise
    warehouse.load(_sources(g), first.store(root))
    first.close()
    second = runlog.Recorder(spark, f"{root}/log", "second")
    warehouse.load(_sources(g), second.store(f"{root}/again"), wanted=["dim_customer"])
    second.close()
    return f"{root}/log"


def _calendar(g: Gold) -> DataFrame:
    """Each day from the first to the last order with its orders."""
    days = _orders(g).groupBy(F.col("order_date").cast("date").alias("full_date")).agg(F.count("*").alias("orders"))
    ends = days.agg(F.min("full_date").alias("a"), F.max("full_date").alias("z"))
    return star.date_columns(ends.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("full_date"))).join(days, "full_date", "left").na.fill(0, ["orders"])


def _year_events(g: Gold) -> DataFrame:
    path = scratch(g.tables.spark)
    io.write_events(g.tables.website_events(), path)
    return g.tables.spark.read.parquet(path).where("event_year = 2024").groupBy("event_year", "event_type").agg(F.count("*").alias("rows"))


def _staged(g: Gold) -> DataFrame:
    path = scratch(g.tables.spark)
    _dirty(g)["orders"].write.option("header", True).csv(path)
    df = io.staged(g.tables.spark, path, "orders", BATCH)
    return df.groupBy(F.col("_batch_date").cast("string").alias("batch_date")).agg(F.count("*").alias("rows"), F.count_if(F.col("_source_file").isNotNull() & F.col("_loaded_at").isNotNull()).alias("traced"), F.count_if(F.col("order_status").isNull()).alias("null_status"))


def _once(g: Gold, df: DataFrame) -> DataFrame:
    path = scratch(g.tables.spark)
    df.limit(10).write.parquet(path)
    io.write_processed(df, path)
    return g.tables.spark.read.parquet(path)


def _refreshed(g: Gold) -> DataFrame:
    """What readers see after a first load, after a refresh that failed half way, and after one that ended; and the first version again."""
    spark, root = g.tables.spark, scratch(g.tables.spark)
    count = lambda at, version=None: versions.read(spark, root, version).groupBy("order_status").agg(F.count("*").alias("rows")).select(F.lit(at).alias("at"), "order_status", "rows")
    versions.publish(_orders(g).where("order_status = 'completed'"), root)
    seen = [count("first")]
    broken = _orders(g).withColumn("order_id", F.when(F.col("order_status") == "pending", F.raise_error(F.lit("no space left")).cast("string")).otherwise(F.col("order_id")))
    try:
        versions.publish(broken, root)
    except Exception as failed:
        if "no space left" not in str(failed):
            raise
    seen.append(count("failed"))
    versions.publish(_orders(g), root, ("order_status",))
    seen += [count("second"), count("again", 1)]
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out


_add("SRC1", lambda g: _plain(_raw_csv(g)), _shape("orders", "d_orders"))
_add("SRC2", lambda g: _plain(_raw_json(g)), _shape("website_events", "x_events"))
_add("SRC3", lambda g: _plain(io.read_batch(g.tables.spark, _batches(g), "orders", "2024-02-01").drop("batch_date")), _shape("orders", "d_orders") + " where right(order_id,1)::int%2=0")
_add("SRC4", lambda g: _plain(io.read_batch(g.tables.spark, _batches(g), "orders", None).groupBy("batch_date").agg(F.count("*").alias("rows"))), "select case when right(order_id,1)::int%2=0 then '2024-02-01' else '2024-02-02' end batch_date, count(*) as rows from d_orders group by 1")
_add("SRC5", _staged, f"select '{BATCH}' batch_date, count(*) as rows, count(*) traced, count(*) filter (order_status is null) null_status from x_orders")
_add("SRC6", lambda g: _plain(io.read_batch(g.tables.spark, _batches(g), "orders", "2024-02-02").groupBy("order_status").agg(F.count("*").alias("rows"))), "select order_status, count(*) as rows from d_orders where right(order_id,1)::int%2=1 group by 1")
_add("SRC7", lambda g: io.source_status(_dirty(g)), "select * from (values " + ",".join(f"('{n}',true)" for n in DIRTY) + ") t(dataset, present) where (select count(*) from d_orders)>0")
_add("SNK1", lambda g: _plain(_once(g, g.tables.customers())), _shape("customers", "d_customers"))
_add("SNK2", lambda g: _plain(_once(g, _orders(g))), _shape("orders", "d_orders"))
_add("SNK2_versions", _refreshed, "select a as at, order_status, count(*) as rows from d_orders, (values ('first'), ('failed'), ('again'), ('second')) t(a) where a = 'second' or order_status = 'completed' group by 1, 2")
_add("SNK3", _replaced, "select '2024-02-01' batch_date, count(*) filter (order_id<'ORD00000100') as rows from d_orders union all select '2024-02-02', count(*) from d_orders")
_add("SNK3_status", _replaced_by_status, "select order_status batch, count(*) as rows, count(*) filter (order_status='completed' or total_amount=0) zeros from d_orders group by 1")
_add("SRC3_status", lambda g: _plain(_status_batch(g, "completed")), _shape("orders", "d_orders") + " where order_status='completed'")
_add("SRC6_status", lambda g: _status_batch(g, "pending").groupBy("payment_method").agg(F.count("*").alias("rows")), "select payment_method, count(*) as rows from d_orders where order_status='pending' group by 1")
_add("SNK4", lambda g: _plain(_year_events(g)), "select cast(2024 as bigint) event_year, event_type, count(*) as rows from d_events where year(event_timestamp)=2024 group by 2")
_add("SNK5", lambda g: _plain(io.insert_absent(g.tables.products().where(F.col("product_id") < "PROD00000100"), g.tables.products(), "product_id")), _shape("products", "d_products"))
_add("SNK5_category", lambda g: _plain(io.insert_absent(g.tables.products().where("category = 'SMALL'").withColumn("brand", F.lit("old")), g.tables.products(), "product_id")), _shape("products", "(select * replace (case when category='SMALL' then 'old' else brand end as brand) from d_products)"))
_add("SNK6", lambda g: io.update_from(g.tables.customers().select("customer_id", F.lit("none").alias("customer_segment")), g.rfm.select("customer_id", "customer_segment"), "customer_id", ["customer_segment"]), "select customer_id, customer_segment from g_rfm")
_add("SNK7", lambda g: quality.report(quality.results(_dirty(g))))
_CASTS = "cast(age as bigint) as age, cast(registration_date as varchar) as registration_date, cast(first_purchase_date as varchar) as first_purchase_date, cast(last_purchase_date as varchar) as last_purchase_date"
_add("SNK8", lambda g: _plain(g.profile_view().withColumn("spend", money(F.col("spend")))), f"select p.* replace ({_CASTS}, {usd('spend')} as spend), v.estimated_lifespan_months, v.estimated_clv from g_profile p left join g_clv v using (customer_id)")

# controlled damage and cleaning

for _name, _source in DIRTY.items():
    _add(f"dirty_{_name}", lambda g, n=_name: _plain(_dirty(g)[n]), _shape(_name, _source).replace("ticket_id,", "cast(ticket_id as varchar) ticket_id,").replace("interaction_id,", "cast(interaction_id as varchar) interaction_id,"))
_C, _P, _O = (lambda g: g.tables.customers()), (lambda g: g.tables.products()), _orders
_add("DRT1", lambda g: dirt.null_share(_O(g), "order_status", "order_id", 0.01, "state").select("order_id", "order_status"), f"select order_id, case when {b('state', 'order_id')}<100 then null else order_status end order_status from d_orders")
_add("DRT2", lambda g: dirt.repeat_share(_C(g), "customer_id", 0.01, "twice").select("customer_id"), f"select customer_id from d_customers union all select customer_id from d_customers where {b('twice', 'customer_id')}<100")
_add("DRT3", lambda g: dirt.break_emails(_C(g), "email", "customer_id", 0.02, "mail").select("customer_id", "email"), "select customer_id, email from x_customers0")
_add("DRT4", lambda g: _plain(dirt.negate_share(_O(g), "total_amount", "order_id", 0.01, "minus").select("order_id", "total_amount")), f"select order_id, cast(case when {b('minus', 'order_id')}<100 then -total_amount else total_amount end as double) total_amount from d_orders")
_add("DRT5", lambda g: dirt.orphan_share(_O(g), "customer_id", "order_id", 0.02, "stray", "CUST").select("order_id", "customer_id"), "select order_id, customer_id from x_orders0")
_add("DRT6", lambda g: _plain(dirt.swap_share(_P(g), "cost", "selling_price", "product_id", 0.02 / 3, "swap")), _shape("products", "x_products"))
_add("DRT7", lambda g: _O(g).select("order_id", F.unix_timestamp("order_date").alias("epoch")), "select order_id, epoch_us(order_date)//1000000 epoch from d_orders")
_add("DRT8", lambda g: _C(g).select("customer_id"), "select 'CUST'||lpad(c_custkey::varchar,8,'0') customer_id from customer")
_add(
    "DRT9",
    lambda g: _O(g).select("order_id").join(g.tables.order_items().groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount"))).alias("s")), "order_id", "left").select("order_id", F.round("s", 2).cast("double").alias("order_total")),
    "select o.order_id, cast(round(s,2) as double) order_total from d_orders o left join (select order_id, sum(quantity*unit_price*(1-discount)) s from d_items group by 1) using (order_id)",
)
_X = lambda g, n: _dirty(g)[n]
_add("CLN1", lambda g: clean.drop_null_key(_X(g, "customers"), "customer_id").select("customer_id"), "select customer_id from x_customers where customer_id is not null")
_add("CLN2", lambda g: _plain(clean.deduplicate(_X(g, "order_items"), ["order_item_id"])), _shape("order_items", "k_items0"))
_add("CLN3", lambda g: clean.flag_invalid_email(_X(g, "customers")).select("customer_id", "email", "is_valid_email"), f"select customer_id, case when regexp_matches(email,{EMAIL}) then email end email, coalesce(regexp_matches(email,{EMAIL}),false) is_valid_email from x_customers")
_add("CLN4", lambda g: _plain(clean.clip_negative(_X(g, "orders"), "total_amount").select("order_id", "total_amount")), "select order_id, cast(case when total_amount>=0 then total_amount end as double) total_amount from x_orders")
_add("CLN5", lambda g: _plain(clean.keep_dates(_C(g), "registration_date", ("1996-01-01", "2000-12-31")).select("customer_id", "registration_date")), "select customer_id, cast(case when registration_date between date '1996-01-01' and date '2000-12-31' then registration_date end as varchar) registration_date from d_customers")
_add("CLN6", lambda g: clean.keep_values(_O(g), "order_status", ["completed", "refunded"]).select("order_id", "order_status"), "select order_id, case when order_status in ('completed','refunded') then order_status end order_status from d_orders")
_add("CLN7", lambda g: clean.split_orphans(_X(g, "orders"), _C(g), "customer_id")[1].select("order_id", "customer_id"), "select order_id, customer_id from x_orders where customer_id not in (select customer_id from d_customers)")
_add("CLN8", lambda g: _plain(clean.null_cost_over_price(_X(g, "products")).select("product_id", "cost", "selling_price")), f"select product_id, {_D('cost')}, {_D('selling_price')} from k_products")
_add("CLN9", lambda g: clean.stamp(_P(g)).agg(F.count("_processed_at").alias("stamped")), "select count(*) stamped from d_products")
_add("CLN10", lambda g: clean.step_counts(_X(g, "orders"), clean.deduplicate(clean.drop_null_key(_X(g, "orders"), "order_id"), ["order_id"]), "order_id"), "select count(*) rows_before, count(*) filter (order_id is null) null_keys, count(distinct order_id) rows_after from x_orders")
_PIPES = {"PIP1": "customers", "PIP2": "products", "PIP3": "orders", "PIP4": "order_items", "PIP5": "payments", "PIP6": "customer_support", "PIP7": "marketing_campaigns", "PIP8": "campaign_interactions", "PIP9": "website_events"}
for _id, _name in _PIPES.items():
    _add(_id, lambda g, n=_name: _plain(_clean(g)[n]), _shape(_name, CLEAN[_name]).replace("customer_status from", "customer_status, is_valid_email from"))
_add("PIP10", lambda g: clean.row_counts({n: _clean(g)[n] for n in _PIPES.values()}), " union all ".join(f"select '{n}' dataset, count(*) as rows from {CLEAN[n]}" for n in _PIPES.values()))
_add(
    "PIP10_all",
    lambda g: clean.row_counts({n: df if n.startswith(("session", "top")) else _plain(df) for n, df in _clean(g).items()}),
    " union all ".join(f"select '{n}' dataset, count(*) as rows from {CLEAN[n]}" for n in _PIPES.values())
    + " union all select 'session_summary', count(*) from (select distinct session_id, customer_id, device, traffic_source from k_events)"
    + " union all select 'top_products_daily', count(*) from (select rank() over (partition by event_timestamp::date order by count(*) desc) r from k_events where event_type='product_view' and product_id is not null group by event_timestamp::date, product_id) where r<=5",
)

# star schema

_S = star
_add("KEY1", lambda g: ranking.dense_key(_C(g).select("customer_id"), "customer_id", "customer_key"), "select customer_id, customer_key from w_customers")
_add("KEY2", lambda g: _S.lookup(_X(g, "orders").select("order_id", "customer_id"), ranking.dense_key(_C(g).select("customer_id"), "customer_id", "customer_key"), "customer_id", "customer_key"), "select x.order_id, x.customer_id, customer_key from x_orders x left join w_customers using (customer_id)")
_add("KEY3", lambda g: _plain(_O(g).select("order_id", date_key(F.col("order_date")).alias("date_key"))), "select order_id, cast(strftime(order_date,'%Y%m%d') as bigint) date_key from d_orders")
_add("KEY4", lambda g: _X(g, "orders").join(_C(g).select("customer_id"), "customer_id", "left_anti").agg(F.count("*").alias("dropped")), "select count(*) dropped from x_orders where customer_id is null or customer_id not in (select customer_id from d_customers)")
_add(
    "DIM1",
    lambda g: _plain(_S.dim_date(g.tables.spark).crossJoin(F.broadcast(_O(g).agg(F.count("*").alias("orders")))).where("orders > 0").drop("orders")),
    """select cast(strftime(d,'%Y%m%d') as bigint) date_key, cast(d as varchar) full_date, year(d) as year, quarter(d) as quarter, month(d) as month, monthname(d) month_name, day(d) as day, dayofweek(d) day_of_week, dayname(d) day_name, weekofyear(d) as week, dayofweek(d) in (0,6) is_weekend
    from (select unnest(generate_series(date '2019-01-01', date '2027-12-31', interval 1 day))::date as d) where (select count(*) from d_orders)>0""",
)
_add(
    "DIM1_days",
    lambda g: _plain(_calendar(g)),
    """select cast(strftime(d,'%Y%m%d') as bigint) date_key, cast(d as varchar) full_date, year(d) as year, quarter(d) as quarter, month(d) as month, monthname(d) month_name, day(d) as day, dayofweek(d) day_of_week, dayname(d) day_name, weekofyear(d) as week, dayofweek(d) in (0,6) is_weekend, coalesce(n,0) orders
    from (select unnest(generate_series((select min(order_date)::date from d_orders), (select max(order_date)::date from d_orders), interval 1 day))::date as d) left join (select order_date::date x, count(*) n from d_orders group by 1) on x=d""",
)
_add("DIM2", lambda g: _S.dim_location(_C(g)), "select city, province, country, location_key from w_places")
_add("DIM3", lambda g: _S.dim_device(g.tables.spark).join(g.tables.website_events().groupBy(F.coalesce("device", F.lit("Unknown")).alias("device_name")).agg(F.count("*").alias("events")), "device_name", "left"), "select cast(device_key as bigint) device_key, device_name, events from w_devices left join (select coalesce(device,'Unknown') device_name, count(*) events from d_events group by 1) using (device_name)")
_add("DIM4", lambda g: _plain(_S.dim_customer(_C(g), _S.dim_location(_C(g)))), f"select customer_key, customer_id, first_name||' '||last_name full_name, email, gender, {_T('date_of_birth')}, location_key, {_T('registration_date')}, customer_status from w_customers join w_places using (city, province, country)")
_add("DIM5", lambda g: _plain(_S.dim_product(_P(g))), f"select product_key, product_id, product_name, category, subcategory, brand, {_D('cost')}, {_D('selling_price')}, {half_up('((selling_price-cost)*100)::bigint', '(selling_price*100)::bigint', 4)} margin_pct from w_products")
_add("DIM6", lambda g: _plain(_S.dim_campaign(g.tables.marketing_campaigns())), f"select campaign_key, {SHAPES['marketing_campaigns']} from w_campaigns")
_add("FCT1", lambda g: _plain(_S.fact_orders(_O(g), ranking.dense_key(_C(g), "customer_id", "customer_key"))), f"select order_key, order_id, customer_key, cast(strftime(order_date,'%Y%m%d') as bigint) date_key, {_U('order_date')}, order_status, payment_method, {_D('total_amount')} from w_orders join w_customers using (customer_id)")
_FO = lambda g: ranking.dense_key(_O(g), "order_id", "order_key")
_add("FCT2", lambda g: _plain(_S.fact_order_items(g.tables.order_items(), _FO(g), ranking.dense_key(_P(g), "product_id", "product_key"))), f"select order_item_id, order_key, product_key, {_I('quantity')}, {_D('unit_price')}, {_D('discount')}, {_D('line_amount')} from s_items join w_orders using (order_id) left join w_products using (product_id)")
_add("FCT3", lambda g: _plain(_S.fact_payments(g.tables.payments(), _FO(g))), f"select payment_id, order_key, cast(strftime(payment_date,'%Y%m%d') as bigint) date_key, p.payment_method, payment_status, {_D('amount')} from d_payments p join w_orders using (order_id)")
_CK = lambda g: ranking.dense_key(_C(g), "customer_id", "customer_key")
_add("FCT4", lambda g: _plain(_S.fact_tickets(g.tables.customer_support(), _CK(g))), f"select ticket_id, customer_key, cast(strftime(created_at,'%Y%m%d') as bigint) date_key, issue_type, priority, status, {_D('resolution_time')} from d_tickets left join w_customers using (customer_id)")
_add("FCT5", lambda g: _plain(_S.fact_interactions(g.tables.campaign_interactions(), _S.dim_campaign(g.tables.marketing_campaigns()), _CK(g))), "select interaction_id, campaign_key, customer_key, interaction_type, cast(strftime(interaction_timestamp,'%Y%m%d') as bigint) date_key from d_touches left join w_campaigns using (campaign_id) left join w_customers using (customer_id)")
_add("FCT6", lambda g: _plain(_S.fact_events(g.tables.website_events(), _CK(g), ranking.dense_key(_P(g), "product_id", "product_key"), _S.dim_device(g.tables.spark))), f"select event_id, customer_key, product_key, cast(device_key as bigint) device_key, session_id, event_type, traffic_source, {_U('event_timestamp')}, year(event_timestamp) event_year from d_events left join w_customers using (customer_id) left join w_products using (product_id) left join w_devices on device_name=coalesce(device,'Unknown')")
_MOMENTS = {"d_orders": "order_date", "d_payments": "payment_date", "d_events": "event_timestamp", "d_tickets": "created_at", "d_touches": "interaction_timestamp"}
_DAYS = " union all ".join(f"select {c}::date as d from {s}" for s, c in _MOMENTS.items())
#: The load's tables: their rows and null keys in SQL.
_LOADED = {
    "dim_date": (f"(select unnest(generate_series(min(d), max(d), interval 1 day)) k from ({_DAYS}))", "0"), "dim_location": ("w_places", "0"), "dim_device": ("w_devices", "0"), "dim_customer": ("d_customers", "0"), "dim_product": ("d_products", "0"), "dim_campaign": ("d_campaigns", "0"),
    "fact_orders": ("s_orders", "0"), "fact_order_items": ("(select product_id, p.selling_price k from d_items join s_orders using (order_id) left join d_products p using (product_id))", "count(*) filter (k is null)"), "fact_payments": ("(select payment_id from d_payments join s_orders using (order_id))", "0"),
    "fact_support_tickets": ("(select ticket_id, c.city k from d_tickets left join d_customers c using (customer_id))", "count(*) filter (k is null)"), "fact_campaign_interactions": ("(select interaction_id, c.channel k from d_touches left join d_campaigns c using (campaign_id))", "count(*) filter (k is null)"), "fact_website_events": ("(select event_id, c.city k from d_events left join d_customers c using (customer_id) where event_timestamp is not null)", "count(*) filter (k is null)"),
}
_add("WHS1", lambda g: clean.row_counts(_star(g)), " union all ".join(f"select '{n}' dataset, count(*) as rows from {s}" for n, (s, _) in _LOADED.items()))
_add("WHS2", lambda g: _S.load_checks(_star(g, ["dim_customer", "dim_product", "fact_orders", "fact_order_items", "fact_website_events"]), {"fact_orders": "customer_key"}), " union all ".join(f"select '{n}' table_name, count(*) as rows, {k} null_keys, true as ok from {s}" for n, s, k in (("dim_customer", "d_customers", "0"), ("dim_product", "d_products", "0"), ("fact_orders", "d_orders", "count(*) filter (customer_id is null)"), ("fact_order_items", "d_items", "0"), ("fact_website_events", "d_events", "0"))))

# data quality

_DQ = {
    "DQ01": ("x_customers", "customer_id is null"), "DQ02": ("x_customers", "email is null"), "DQ03": ("x_orders", "order_id is null"), "DQ04": ("x_orders", "customer_id is null"), "DQ05": ("x_items", "product_id is null"),
    "DQ06": ("x_customers", "customer_id"), "DQ07": ("x_orders", "order_id"), "DQ08": ("x_items", "order_item_id"), "DQ09": ("x_customers", f"email is null or not regexp_matches(email,{EMAIL})"),
    "DQ10": ("x_customers", "customer_status is null or customer_status not in ('active','inactive','churned')"), "DQ11": ("x_orders", "order_status is null or order_status not in ('completed','cancelled','pending','refunded')"), "DQ12": ("x_orders", "total_amount<0"),
    "DQ13": ("x_items", "unit_price<0"), "DQ14": ("x_payments", "amount<0"), "DQ15": ("x_products", "cost>selling_price"),
    "DQ16": ("(select o.*, s from x_orders o left join (select order_id, sum(quantity*unit_price*(1-discount)) s from x_items group by 1) using (order_id))", "abs(coalesce(total_amount,0)-coalesce(s,0))>1"),
    "DQ17": ("x_orders", "customer_id is not null and customer_id not in (select customer_id from x_customers where customer_id is not null)"), "DQ18": ("x_items", "product_id not in (select product_id from x_products)"), "DQ19": ("x_items", "order_id not in (select order_id from x_orders)"),
    "DQ20": ("x_payments", "order_id not in (select order_id from x_orders)"), "DQ21": ("x_events", "customer_id is not null and customer_id not in (select customer_id from x_customers where customer_id is not null)"), "DQ22": ("x_touches", "campaign_id not in (select campaign_id from d_campaigns)"),
    "DQ23": ("(select p.amount, o.total_amount from x_payments p join x_orders o using (order_id))", "abs(amount-total_amount)>0.01"),
}


def _dq_sql(check: str) -> str:
    source, bad = _DQ[check]
    failed = f"greatest(count({bad})-count(distinct {bad}),0)" if check in ("DQ06", "DQ07", "DQ08") else f"count(*) filter ({bad})"
    return f"select '{check}' check_id, count(*) total, {failed} failed from {source}"


for _id in _DQ:
    _add(_id, lambda g, i=_id: quality.results(_dirty(g), only=[i]).select("check_id", "total", "failed"), _dq_sql(_id))
_ALL = " union all ".join(_dq_sql(c) for c in _DQ)
_META = "(values " + ",".join(f"('{c}','{d}','{m}',{str(k).lower()})" for c, d, _, m, k in quality.CHECKS) + ") m(check_id, dataset, dimension, critical)"
_RATED = f"(select r.*, dataset, dimension, critical, case when total=0 then 1.0 else round((total-failed)::double/total,4) end pass_rate from ({_ALL}) r join {_META} using (check_id))"
_STATUS = "case when pass_rate>=0.95 then 'PASS' else 'FAIL' end"
_RESULTS = lambda g: quality.results(_dirty(g))
_REPORT = "{'check_id':check_id,'dataset':dataset,'dimension':dimension,'critical':critical,'total':total,'failed':failed,'status':" + _STATUS + "}"
ORACLES["SNK7"] = sql(f"select cast(to_json({{'checks':count(*),'failed_checks':count(*) filter (pass_rate<0.95),'results':list({_REPORT} order by check_id)}}) as varchar) report from {_RATED}")
_add("DQG1", lambda g: _RESULTS(g).drop("check_name"), f"select check_id, dataset, dimension, critical, total, failed, pass_rate, {_STATUS} status from {_RATED}")
_add("DQG2", _kept_results, f"select check_id, '{BATCH}' batch_date, case when total>0 then pass_rate end pass_rate from {_RATED}")
_add("DQG3", lambda g: quality.gate(_RESULTS(g)), f"select count(*) checks, count(*) filter (critical and pass_rate<0.95) critical_failures, case when count(*) filter (critical and pass_rate<0.95)=0 then 'PASS' else 'FAIL' end overall from {_RATED}")
_add("DQG4", lambda g: _RESULTS(g).select("check_id", "status"), f"select check_id, {_STATUS} status from {_RATED}")
_add("DQG4_all", lambda g: quality.summary(_RESULTS(g)), f"select check_id, {_STATUS} status, case when max((critical and pass_rate<0.95)::int) over ()=1 then 'FAIL' else 'PASS' end overall from {_RATED}")
_add("DQG5", lambda g: quality.by_dimension(_RESULTS(g)), f"select dimension, count(*) checks, count(*) filter (pass_rate>=0.95) passed, cast(sum(failed) as bigint) failed_records from {_RATED} group by 1")

# events

_add("EVT1", lambda g: _plain(events.session_summary(g.tables.website_events())), "select session_id, customer_id, device, traffic_source, count(*) event_count, epoch_us(min(event_timestamp)) session_start, epoch_us(max(event_timestamp)) session_end, cast(max((event_type='purchase')::int) as bigint) converted, epoch_us(max(event_timestamp))//1000000-epoch_us(min(event_timestamp))//1000000 duration_seconds from d_events group by 1,2,3,4")
_add("EVT2", lambda g: _plain(events.top_viewed(g.tables.website_events())), "select * from (select cast(event_timestamp::date as varchar) event_date, product_id, count(*) view_count, rank() over (partition by event_timestamp::date order by count(*) desc) as rank from d_events where event_type='product_view' group by event_timestamp::date, product_id) where rank<=5")

# gold

_M = lambda c: F.col(c).cast("string").alias(c)
_add("C01", lambda g: _plain(g.order_stats()), f"select customer_id, total_orders, completed_orders, cancelled_orders, spend, {_T('first_purchase_date')}, {_T('last_purchase_date')} from c_orders")
_add("C02", lambda g: g.favourite_product(), "select customer_id, favorite_product from c_product")
_add("C03", lambda g: g.favourite_category(), "select customer_id, favorite_category from c_category")
_add("C04", lambda g: g.web_stats(), "select customer_id, website_sessions, website_events from c_web")
_add("C05", lambda g: g.ticket_stats(), "select customer_id, support_tickets, resolved_tickets, average_resolution_time from c_tickets")
_add("C06", lambda g: g.campaign_stats(), "select customer_id, campaign_interactions from c_touches")
_add("C07", lambda g: _plain(g.base_profile), f"select * replace ({_CASTS}) from base")
_add("C08", lambda g: g.people.select("customer_id", "age"), "select customer_id, cast(age as bigint) age from base")
_add("C09", lambda g: g.buying.select("customer_id", "purchase_frequency"), "select customer_id, purchase_frequency from base")
_R = "customer_id, recency_days, frequency, spend, cast(r_score as bigint) r_score, cast(f_score as bigint) f_score, cast(m_score as bigint) m_score, rfm_score, cast(rfm_sum as bigint) rfm_sum"
_add("R01", lambda g: _plain(g.rfm.where("frequency > 0").drop("customer_segment", "registration_date")), f"select {_R} from g_rfm where frequency>0")
_add("R02", lambda g: _plain(g.rfm.where("frequency = 0").drop("customer_segment", "registration_date")), f"select {_R} from g_rfm where frequency=0")
_add("R03", lambda g: g.rfm.select("customer_id", "customer_segment"), "select customer_id, customer_segment from g_rfm")
_add("R04", lambda g: g.buying_profile.select("customer_id", "rfm_score", "customer_segment"), "select customer_id, rfm_score, customer_segment from g_profile")
_add("T01", lambda g: g.customer_months().select("customer_id", _M("month")), "select customer_id, cast(m as varchar) as month from cm")
_add("T02", lambda g: g.first_months().select("customer_id", _M("cohort_month")), "select customer_id, cast(f as varchar) cohort_month from fm")
_add("T03", lambda g: g.spine().select(_M("metric_month")), "select cast(m as varchar) metric_month from spine")
_add("T04", lambda g: g.monthly_revenue().select(_M("metric_month"), money(F.col("revenue")).alias("revenue")), f"select cast(m as varchar) metric_month, {usd('r')} revenue from rev")
_add("T05", lambda g: g.month_activity().select(_M("metric_month"), "active", "new"), "select cast(m as varchar) metric_month, a active, n as new from act")
_add("T06", lambda g: g.month_activity().select(_M("metric_month"), "retained"), "select cast(spine.m as varchar) metric_month, coalesce(k,0) retained from spine left join ret on ret.m=spine.m")
_MONTHLY = f"select cast(m as varchar) metric_month, a active_customers, n new_customers, a-n returning_customers, retention_rate, churn_rate, repeat_purchase_rate, {usd('r')} total_revenue from g_month"
_COHORT = "select cast(f as varchar) cohort_month, p period_number, a active_customers, z cohort_size, retention_rate from g_cohort"
_add("T07", lookup.monthly_metrics, _MONTHLY)
_add("T08", lookup.cohorts, _COHORT)
_add("L01", lambda g: g.mean_churn().select((F.col("churn10k").cast("double") / 10000 / F.col("months")).alias("mean_churn")), "select c::double/10000/n mean_churn from churn")
_add("L02", lambda g: g.lifespan().select((F.col("top").cast("double") / F.col("bottom")).alias("lifespan_months")), "select t::double/u lifespan_months from life")
_add("L03", lambda g: g.clv, "select * from g_clv")

# reports

_Q = {
    "Q01": f"select customer_id, customer_name, customer_segment, total_orders, {usd('spend')} revenue from g_profile order by spend desc, customer_id limit 10",
    "Q02": f"select product_id, product_name, category, cast(sum(quantity) as bigint) units_sold, {usd('sum(line)')} revenue from s_lines where done group by 1,2,3 order by sum(line) desc nulls last, product_id limit 10",
    "Q03": f"select customer_segment, count(*) customer_count, {usd('sum(spend)')} total_revenue, {half_up('sum(spend)', '(count(*)*100)', 2)} avg_revenue_per_customer from g_rfm group by 1",
    "Q04": f"select cast(m as varchar) as month, {usd('r')} revenue, {usd('p')} prev_month_revenue, {pct('r-p', 'p')} mom_growth_pct from (select *, lag(r) over (order by m) p from rev)",
    "Q05": f"select cast(m as varchar) metric_month, a active_customers, retention_rate, {half_up('s', '(k*10000)', 4)} retention_rate_3mo_avg from (select *, sum(round(retention_rate*10000)::bigint) over w s, count(retention_rate) over w k from g_month window w as (order by m rows 2 preceding)) order by m desc limit 12",
    "Q06": f"select customer_id, customer_name, total_orders, {usd('spend')} total_spend, {_T('last_purchase_date')}, days_since_last_purchase, case when total_orders=0 then 'Never purchased' when days_since_last_purchase>365 then 'Inactive > 1 year' else 'Inactive 90-365 days' end churn_reason from g_profile where customer_segment='Lost Customers'",
    "Q07": f"select customer_id, customer_name, g.customer_segment, recency_days, frequency, {usd('g.spend')} monetary, p.spend>(select avg(spend) from base where total_orders>0) above_average_spender from g_rfm g join g_profile p using (customer_id) where g.customer_segment in ('At Risk','Can''t Lose Them')",
    "Q08": f"select cast(m as varchar) as month, {usd('v')} avg_order_value, n order_count, {half_up('sum(v) over w', '((count(*) over w)*100)', 2)} running_avg_aov from (select date_trunc('month',d)::date as m, count(*) n, {half_up('sum(amount)', 'count(*)', 0)}::bigint v from s_orders where done group by 1) window w as (order by m rows unbounded preceding)",
    "Q09": f"select count(*) filter (completed_orders>=2) repeat_customers, count(*) filter (completed_orders>=1) all_purchasers, {half_up('count(*) filter (completed_orders>=2)', 'count(*) filter (completed_orders>=1)', 4)} repeat_purchase_rate from c_orders",
    "Q10": f"select province, customers, {usd('r')} revenue, {pct('r', '(sum(r) over ())')} pct_of_total_revenue from (select province, count(distinct customer_id) customers, sum(amount)::bigint r from s_orders join d_customers using (customer_id) where done group by 1)",
    "Q11": f"select category, {usd('sum(line)')} net_revenue, rank() over (order by sum(line) desc nulls last) revenue_rank from s_lines where done group by 1",
    "Q12": "select cast(m as varchar) as month, n new_customers, cast(sum(n) over (order by m rows unbounded preceding) as bigint) cumulative_customers from (select date_trunc('month',registration_date)::date as m, count(*) n from d_customers group by 1)",
    "Q13": f"select case when estimated_clv=0 then '0 (no purchases)' when estimated_clv<1000 then '1 - 999' when estimated_clv<5000 then '1,000 - 4,999' when estimated_clv<20000 then '5,000 - 19,999' else '20,000+' end clv_bucket, count(*) customer_count, {half_up('sum(round(estimated_clv*100)::hugeint)', '(count(*)*100)', 2)} avg_clv_in_bucket from g_clv group by 1",
    "Q14": f"select customer_segment, count(*) customer_count, {half_up('sum(r_score)', 'count(*)', 2)} avg_r_score, {half_up('sum(f_score)', 'count(*)', 2)} avg_f_score, {half_up('sum(m_score)', 'count(*)', 2)} avg_m_score, {half_up('sum(rfm_sum)', 'count(*)', 2)} avg_rfm_sum from g_rfm group by 1",
    "Q15": f"select campaign_name, channel, {_D('budget')}, i impressions, c clicks, v conversions, {pct('c', 'i')} click_through_rate_pct, {pct('v', 'c')} conversion_rate_pct from (select campaign_id, campaign_name, channel, budget, count(*) filter (interaction_type='impression') i, count(*) filter (interaction_type='click') c, count(*) filter (interaction_type='conversion') v from d_campaigns left join d_touches using (campaign_id) group by all)",
    "Q16": f"select issue_type, priority, count(*) ticket_count, count(*) filter (status in ('resolved','closed')) resolved_count, {pct('''count(*) filter (status in ('resolved','closed'))''', 'count(*)')} resolution_rate_pct, {half_up('sum((resolution_time*100)::bigint)', '(count(resolution_time)*100)', 2)} avg_resolution_hours from d_tickets group by 1,2",
    "Q17": f"select *, {pct('added_to_cart', 'viewed_product')} view_to_cart_pct, {pct('purchased', 'started_checkout')} checkout_to_purchase_pct, {pct('purchased', 'total_sessions')} overall_conversion_pct from (select count(*) total_sessions, " + ", ".join(f"cast(sum({c}) as bigint) {c}" for c in ("viewed_product", "added_to_cart", "started_checkout", "purchased")) + " from flags)",
    "Q18": f"select *, {pct('converting_sessions', 'sessions')} conversion_rate_pct from (select coalesce(device,'Unknown') device_name, count(distinct session_id) sessions, count(*) total_events, count(distinct session_id) filter (event_type='purchase') converting_sessions from d_events group by 1)",
    "Q19": f"select customer_id, first_name||' '||last_name customer_name, {usd('r')} revenue, {usd('c')} cost_of_goods, {usd('r-c')} gross_profit, {pct('r-c', 'r')} gross_margin_pct, rank() over (order by r-c desc) profitability_rank from (select customer_id, coalesce(sum(line),0) r, coalesce(sum(quantity*unit_cost),0) c from s_lines where done group by 1) join d_customers using (customer_id) order by r-c desc, customer_id limit 10",
    "Q20": f"select customer_segment, n customer_count, {pct('n', '(sum(n) over ())')} pct_of_customers, {usd('r')} revenue, {pct('r', '(sum(r) over ())')} pct_of_revenue, {pct('sum(r) over (order by r desc, customer_segment rows unbounded preceding)', '(sum(r) over ())')} cumulative_pct_of_revenue from (select customer_segment, count(*) n, sum(spend)::bigint r from g_rfm group by 1)",
}
for _id, _build in reports.REPORTS.items():
    _add(_id, _build, _Q[_id])

# look-ups

_PAGE = f"select customer_id, customer_name, customer_segment, rfm_score, location, total_orders, completed_orders, {usd('spend')} total_spend, average_order_value, purchase_frequency, favorite_category, favorite_product from g_profile"
_add("A01", lambda g: lookup.customers(g, segment="Lost Customers", q="cust", limit=20, offset=5), _PAGE + " where customer_segment='Lost Customers' and (customer_id ilike '%cust%' or customer_name ilike '%cust%') order by spend desc nulls last, customer_id limit 20 offset 5")
_add("A02", lambda g: lookup.customer(g, ONE), _PAGE + f" where customer_id='{ONE}'")
_add("A03", lambda g: lookup.customer_orders(g, ONE), f"select order_id, cast(d as varchar) order_date, order_status, payment_method, {usd('amount')} total_amount from s_orders where customer_id='{ONE}' order by s_orders.order_date desc, order_id limit 20")
_add("A04", lambda g: lookup.customer_top_products(g, ONE), f"select product_name, category, count(*) order_count, cast(sum(quantity) as bigint) total_quantity from s_lines where customer_id='{ONE}' group by 1,2 order by 3 desc, 4 desc, 1, 2 limit 5")
_add("A05", lambda g: lookup.device_counts(g, ONE), f"select coalesce(device,'Unknown') device_name, count(*) event_count from d_events where customer_id='{ONE}' group by 1")
_add("A06", lambda g: lookup.customer_recent_events(g, ONE), f"select event_id, epoch_us(event_timestamp) event_us, event_type, traffic_source from d_events where customer_id='{ONE}' order by event_timestamp desc, event_id limit 10")
_add("A07", lambda g: _plain(lookup.rfm(g, 50, 10)), f"select {_R.replace('spend', usd('spend') + ' monetary')} from g_rfm order by g_rfm.rfm_sum desc, customer_id limit 50 offset 10")
_add("A08", lambda g: _plain(lookup.rfm_grid(g)), "select cast(r_score as bigint) r_score, cast(m_score as bigint) m_score, count(*) customer_count from g_rfm where frequency>0 group by 1,2")
_add("A09", lookup.segments, f"select customer_segment, count(*) customer_count, {half_up('sum(spend)', '(count(*)*100)', 2)} avg_clv, {usd('sum(spend)')} total_spend from g_rfm group by 1")
_add("A10", lookup.monthly_metrics, _MONTHLY)
_add("A11", lookup.cohorts, _COHORT)
_add("A12", lookup.revenue_by_category, f"select category, {usd('sum(gross)')} gross_revenue, count(distinct order_id) order_count from s_lines where done group by 1")
_add("A13", lookup.device_counts, "select coalesce(device,'Unknown') device_name, count(*) event_count from d_events group by 1")
_add("A14", lookup.traffic_sources, "select coalesce(traffic_source,'Unknown') traffic_source, count(*) event_count from d_events group by 1")
_VIEWED = "select product_name, count(*) view_count from d_events join d_products using (product_id) where event_type='product_view' {} group by 1 order by 2 desc, 1 limit 10"
_add("A15", lookup.top_viewed_products, _VIEWED.format(""))
_add("A16", lookup.events_trend, "select cast(date_trunc('month',event_timestamp)::date as varchar) as month, count(*) event_count from d_events group by 1")
_add("A17", lambda g: lookup.quality_results(_RESULTS(g), "orders", 5).select("check_id", "total", "failed"), f"select check_id, total, failed from {_RATED} where dataset='orders' order by check_id desc limit 5")

# measures and dashboard data sets

_mean = lambda c, source, by="": f"select {by} {half_up(f'sum(round({c}*10000)::bigint)', f'(count({c})*10000)', 4)} {{}} from {source}"
_meanmoney = lambda c, source, by="": f"select {by} {half_up(f'sum(round({c}*100)::hugeint)', f'(count({c})*100)', 2)} {{}} from {source}"
_MEASURES = {
    "M01": (measures.total_revenue, f"select {usd('sum(amount) filter (done)')} total_revenue from s_orders"),
    "M02": (measures.total_customers, "select count(distinct customer_id) total_customers from d_customers"),
    "M03": (measures.active_customers, "select count(distinct customer_id) active_customers from d_customers where customer_status='active'"),
    "M04": (measures.average_order_value, f"select {half_up('sum(amount) filter (done)', '((count(*) filter (done))*100)', 2)} average_order_value from s_orders"),
    "M05": (measures.completed_orders, "select count(*) filter (done) completed_orders from s_orders"),
    "M06": (measures.historical_clv, _meanmoney("historical_clv", "g_clv").format("customer_lifetime_value")),
    "M07": (measures.estimated_clv, _meanmoney("estimated_clv", "g_clv").format("estimated_clv")),
    "M08": (measures.retention_rate, _mean("retention_rate", "g_month").format("retention_rate")),
    "M09": (measures.churn_rate, _mean("churn_rate", "g_month").format("churn_rate")),
    "M10": (measures.repeat_purchase_rate, _mean("repeat_purchase_rate", "g_month").format("repeat_purchase_rate")),
    "M11": (measures.revenue_growth, f"select cast(x.m as varchar) as month, {usd('x.r')} revenue, {pct('x.r-y.r', 'y.r')} mom_growth_pct from rev x left join rev y on y.m=(x.m - interval 1 month)::date"),
    "M12": (measures.customer_growth, "select cast(registration_date as varchar) registration_date, cast(sum(count(*)) over (order by registration_date) as bigint) customers from d_customers group by d_customers.registration_date"),
    "M13": (measures.revenue_share, f"select customer_segment, {pct('r', '(sum(r) over ())')} revenue_pct from (select customer_segment, sum(spend)::bigint r from g_rfm group by 1)"),
    "M14": (measures.segment_customers, "select customer_segment, count(distinct customer_id) customers from g_rfm group by 1"),
    "M15": (measures.cohort_retention, _mean("retention_rate", "g_cohort group by 1", "p period_number,").format("cohort_retention")),
    "M16": (measures.sessions, "select count(distinct session_id) sessions from d_events"),
    "M17": (measures.conversion_rate, f"select {half_up('''count(distinct session_id) filter (event_type='purchase')''', 'count(distinct session_id)', 4)} conversion_rate from d_events"),
    "V01": (measures.clv_by_segment, _meanmoney("estimated_clv", "g_clv join g_rfm using (customer_id) group by 1", "customer_segment,").format("avg_clv")),
    "V02": (lambda g: _plain(measures.score_grid(g)), "select cast(r_score as bigint) r_score, cast(f_score as bigint) f_score, customer_segment, count(*) customers from g_rfm group by 1,2,3"),
    "V03": (measures.new_and_returning, "select cast(m as varchar) as month, 'new_customers' kind, n customers from g_month union all select cast(m as varchar), 'returning_customers', a-n from g_month"),
    "V04": (measures.cohort_matrix, "select cast(f as varchar) cohort_month, " + ", ".join(f"max(retention_rate) filter (p={k}) m{k}" for k in range(12)) + " from g_cohort group by 1"),
    "V04_all": (measures.whole_cohort_matrix, "select cast(f as varchar) cohort_month, p//12*12 first_period, " + ", ".join(f"max(retention_rate) filter (p%12={k}) m{k}" for k in range(12)) + " from g_cohort group by 1,2"),
    "V05": (measures.events_by_day, f"select {day('event_timestamp')} as day, event_type, count(*) events from d_events group by 1,2"),
    "V06": (measures.five_steps, " union all ".join(f"select '{c}' step, cast(sum({c}) as bigint) sessions from flags" for c in ("seen", "viewed_product", "added_to_cart", "started_checkout", "purchased"))),
    "V07": (measures.sessions_by_source, "select coalesce(traffic_source,'Unknown') traffic_source, count(distinct session_id) sessions from d_events group by 1"),
    "V08": (lambda g: lookup.top_viewed_products(g, 10, "2024-01-05", "2024-01-20"), _VIEWED.format("and event_timestamp::date between date '2024-01-05' and date '2024-01-20'")),
    "V09": (measures.concentration, f"select value_group, {pct('n', '(sum(n) over ())')} pct_of_customers, {pct('r', '(sum(r) over ())')} pct_of_revenue from (select case when customer_segment in ('Champions','Loyal Customers') then 'top' when customer_segment='Lost Customers' then 'lost' else 'middle' end value_group, count(*) n, sum(spend)::bigint r from g_rfm group by 1)"),
    "V10": (measures.repeat_by_activity, f"select {AS_OF}-last_purchase_date>90 inactive_over_90_days, count(*) customers, {half_up('count(*) filter (completed_orders>=2)', 'count(*)', 4)} repeat_rate from c_orders where completed_orders>0 group by 1"),
    "V11": (lambda g: measures.revenue_slice(g, [F.col("province") == "ASIA"], ["month", "category", "customer_segment"]), f"select cast(date_trunc('month',l.d)::date as varchar) as month, category, customer_segment, {usd('sum(line)')} revenue from s_lines l join d_customers using (customer_id) join g_rfm using (customer_id) where done and province='ASIA' group by 1,2,3"),
    "V12": (lambda g: measures.customer_page(g, ONE), f"select customer_id, customer_name, customer_segment, rfm_score, {usd('spend')} total_spend, estimated_clv, coalesce(total_orders,0) orders, (select max(cast(d as varchar)) from s_orders where customer_id='{ONE}') last_order, support_tickets tickets from g_profile join g_clv using (customer_id) where customer_id='{ONE}'"),
}
for _id, (_build, _body) in _MEASURES.items():
    _add(_id, _build, _body)

# run log: each day of events is a run, its steps are the tables of that day

_LOG = lambda g: runlog.steps_of_tables({"events": g.tables.website_events().withColumnRenamed("event_timestamp", "at"), "tickets": g.tables.customer_support().withColumnRenamed("created_at", "at")}, "at")


def _log(g: Gold) -> DataFrame:
    """The stored log, to which each table's steps have been added in turn."""
    path = scratch(g.tables.spark)
    for name, df, at in (("events", g.tables.website_events(), "event_timestamp"), ("tickets", g.tables.customer_support(), "created_at")):
        runlog.append_steps(runlog.steps_of_tables({name: df.withColumnRenamed(at, "at")}, "at"), path)
    return g.tables.spark.read.parquet(path)


_CHECKED = lambda g: g.tables.customer_support().groupBy(F.to_date("created_at").cast("string").alias("run_id"), "priority").agg(F.count("*").alias("failed")).select("run_id", F.when(F.col("failed") > 20, "FAIL").otherwise("PASS").alias("status"), "failed")
_STEPS = " union all ".join(f"select {day(c)} run_id, '{n}' step, min({c}) a, max({c}) z, count(*) records, case when count(*)<10 then 'FAILED' else 'SUCCESS' end status from {s} group by 1" for n, s, c in (("events", "d_events", "event_timestamp"), ("tickets", "d_tickets", "created_at")))
_SECONDS = "cast(epoch_us(z)//1000000-epoch_us(a)//1000000 as double)"
_CHECKS = f"select {day('created_at')} run_id, priority, count(*) failed from d_tickets group by 1,2"
_RUNS = f"select run_id, count(*) steps, sum({_SECONDS}) duration_seconds, cast(sum(records) as bigint) records, count(*) filter (status='FAILED') failed_steps from ({_STEPS}) group by 1"
_add("RUN1", lambda g: _log(g).select("run_id", "step", "status", "records"), f"select run_id, step, status, records from ({_STEPS})")
_add("RUN2", lambda g: runlog.with_duration(_log(g)).select("run_id", "step", "duration_seconds"), f"select run_id, step, {_SECONDS} duration_seconds from ({_STEPS})")
_add("RUN3", lambda g: runlog.close_runs(_LOG(g), _CHECKED(g)), f"select r.*, coalesce(n,0) quality_checks, coalesce(f,0) failed_records, case when coalesce(bad,0)>0 then 'FAIL' else 'PASS' end quality_status, case when failed_steps>0 then 'FAILED' else 'SUCCESS' end status from ({_RUNS}) r left join (select run_id, count(*) n, cast(sum(failed) as bigint) f, count(*) filter (failed>20) bad from ({_CHECKS}) group by 1) using (run_id)")
_add("RUN4", lambda g: runlog.newest(_LOG(g), 5).select("run_id"), f"select run_id from ({_STEPS}) group by 1 order by max(z) desc, run_id limit 5")
_add("RUN5", lambda g: runlog.close_runs(_LOG(g), _CHECKED(g)).select("run_id", "status"), f"select run_id, case when failed_steps>0 then 'FAILED' else 'SUCCESS' end status from ({_RUNS})")

_TRIED = [("first", "fact_website_events", 1, None)] + [("first", n, 2 if n == "fact_website_events" else 1, n) for n in _LOADED] + [("second", n, 1, n) for n in ("dim_location", "dim_customer")]
_TRIES = " union all ".join(f"select '{r}' run_id, '{n}' step, {a}::bigint attempt, '{'SUCCESS' if s else 'FAILED'}' status, {'count(*)' if s else 'null::bigint'} records, {_LOADED[s][1] if s else 'null::bigint'} null_keys, {not s} failed" + (f" from {_LOADED[s][0]}" if s else "") for r, n, a, s in _TRIED)
_add(
    "RUN1_load",
    lambda g: _plain(runlog.read_tries(g.tables.spark, _recorded(g)).select("run_id", "step", "attempt", "status", "records", "null_keys", F.coalesce(F.col("error").contains("no space left"), F.lit(False)).alias("failed"))),
    f"select run_id, step, attempt, status, records, null_keys::bigint null_keys, failed from ({_TRIES})",
)
_add(
    "RUN2_load",
    lambda g: runlog.read_runs(g.tables.spark, _recorded(g)).select("run_id", "status", "steps", "failed_steps", "records", "null_keys", (F.col("duration_seconds") > 0).alias("timed")),
    f"select run_id, 'SUCCESS' status, count(*) steps, 0::bigint failed_steps, sum(records)::bigint records, sum(null_keys)::bigint null_keys, true timed from ({_TRIES}) where status='SUCCESS' group by 1",
)

# gold tables kept batch by batch: the first batch comes twice, as a repeated load must not count twice; every batch refreshes the stored profile

#: Where the batches of the kept gold tables part.
_CUTS = (("1", None, "1996-01-01"), ("1", None, "1996-01-01"), ("2", "1996-01-01", "2024-01-15"), ("3", "2024-01-15", None))


def _kept(g: Gold, profile: str | None = None, names: Collection[str] = tuple(kept.COLUMNS)) -> kept.KeptGold:
    states = kept.KeptStates(g.tables.spark, scratch(g.tables.spark))
    for batch, first, end in _CUTS:
        states.add(batch, kept.Batch(g.tables, first, end), names)
        if profile is not None:
            kept.refresh_profile(states, g.tables, profile, batch)
    return kept.KeptGold(states, g.tables)


def _kept_profile(g: Gold) -> DataFrame:
    path = scratch(g.tables.spark)
    _kept(g, path)
    return g.tables.spark.read.parquet(path).drop("bucket")


_add("C07_kept", lambda g: _plain(_kept_profile(g)), f"select * replace ({_CASTS}) from base")
#: Scores and lifetime values stand on the orders' states alone.
_add("R03_kept", lambda g: _kept(g, names=["orders"]).rfm.select("customer_id", "rfm_score", "customer_segment"), "select customer_id, rfm_score, customer_segment from g_rfm")
_add("L03_kept", lambda g: _kept(g, names=["orders"]).clv, "select * from g_clv")
_add("SNK8_kept", lambda g: _plain(_kept(g).profile_view().withColumn("spend", money(F.col("spend")))), f"select p.* replace ({_CASTS}, {usd('spend')} as spend), v.estimated_lifespan_months, v.estimated_clv from g_profile p left join g_clv v using (customer_id)")

# look-ups of one customer over stored tables in buckets of customers


def _served(g: Gold, *names: str) -> served.Customer:
    root = scratch(g.tables.spark)
    served.store(g, root, names)
    return served.Customer(g.tables.spark, root, ONE)


_SERVED: dict[str, tuple[Callable[[Gold, str], DataFrame], tuple[str, ...]]] = {
    "A02": (lookup.customer, ("profile",)), "A03": (lookup.customer_orders, ("orders",)), "A04": (lookup.customer_top_products, ("lines",)), "A05": (lookup.device_counts, ("events",)),
    "A06": (lookup.customer_recent_events, ("events",)), "V12": (measures.customer_page, ("profile", "orders", "tickets")),
}
for _id, (_look, _names) in _SERVED.items():
    QUERIES[f"{_id}_served"] = lambda spark, folder, f=_look, n=_names: f(_served(Gold(Tables(spark, folder)), *n), ONE)
    ORACLES[f"{_id}_served"] = ORACLES[_id]

# tables stored by ranges, merged into where a change meets them

#: Orders from this day on are what the change brings.
_LATE = "2001-01-01"


def _merged_orders(g: Gold) -> DataFrame:
    """Orders up to a day, stored by ranges of the order date; then all late orders, whose pending ones are now completed, are merged in twice."""
    orders, late = g.tables.orders(), F.col("order_date") >= F.lit(_LATE).cast("timestamp")
    table = ranges.RangedTable(g.tables.spark, scratch(g.tables.spark), "order_id", "order_date")
    table.create(orders.where(~late | (F.col("order_status") == "pending")), 16)
    changes = orders.where(late).withColumn("order_status", F.when(F.col("order_status") == "pending", "completed").otherwise(F.col("order_status")))
    table.merge(changes, ["order_status"])
    table.merge(changes, ["order_status"])
    return table.read()


_add("SNK6_ranges", lambda g: _plain(_merged_orders(g)), _shape("orders", f"(select * replace (case when order_status='pending' and order_date>=timestamp '{_LATE}' then 'completed' else order_status end as order_status) from d_orders)"))

# session counts from one stored cube of bitmaps, filled by the same batches


def _cube(g: Gold) -> cube.SessionCube:
    out = cube.SessionCube(g.tables.spark, scratch(g.tables.spark))
    for batch, first, end in _CUTS:
        out.add(batch, kept.Batch(g.tables, first, end).website_events())
    return out


for _id, _from in {"Q17": cube.funnel, "Q18": cube.devices, "V06": cube.five_steps, "V07": cube.sessions_by_source, "M16": cube.sessions, "M17": cube.conversion_rate}.items():
    QUERIES[f"{_id}_cube"] = lambda spark, folder, f=_from: f(_cube(Gold(Tables(spark, folder))))
    ORACLES[f"{_id}_cube"] = ORACLES[_id]
_add(
    "V07_rollup",
    lambda g: cube.source_by_month(_cube(g)),
    "select cast(m as varchar) as month, s traffic_source, count(distinct session_id) sessions, count(distinct session_id) filter (event_type='purchase') bought, count(*) events from (select *, date_trunc('month', event_timestamp)::date m, coalesce(traffic_source,'Unknown') s from d_events) group by cube (m, s)",
)

# from raw files to reports: the damaged tables are written as the raw files of a run


#: Rows of a raw file at most. The files are packed, and a packed file is read by one task.
_RAW_ROWS = 500_000


def _raw_files(g: Gold, left_out: tuple[str, ...] = (), emptied: tuple[str, ...] = ()) -> str:
    root = scratch(g.tables.spark)
    for name, df in _dirty(g).items():
        if name not in left_out:
            path, df = io.folder(root, "raw", name), df.limit(0) if name in emptied else df
            df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in schemas.schema(name).names])
            writer = df.write.option("compression", "gzip").option("maxRecordsPerFile", _RAW_ROWS).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            writer.json(path) if schemas.DATASETS[name][2] == "json" else writer.option("header", True).csv(path)
    return root


def _from_raw(g: Gold) -> retail.StoredGold:
    """A run over raw files that were written for it alone."""
    return retail.run(g.tables.spark, _raw_files(g), "run", "2001-09-01", DATES, keep_raw=False)


def _rejected(g: Gold) -> DataFrame:
    """Raw orders and events with words where numbers and moments should be: what is rejected, and how many rows have a value, by column."""
    spark, root = g.tables.spark, scratch(g.tables.spark)
    word = lambda c, salt, key, share, text: F.when(bucket(salt, key) < share, F.lit(text)).otherwise(F.col(c).cast("string")).alias(c)
    k, e = F.col("order_id"), F.col("event_id").cast("string")
    _orders(g).select("order_id", "customer_id", word("order_date", "when", k, 100, "soon"), "order_status", "payment_method", word("total_amount", "word", k, 150, "n/a")).write.option("header", True).csv(f"{root}/orders")
    g.tables.website_events().select(e.alias("event_id"), "customer_id", "session_id", word("event_timestamp", "when", e, 100, "yesterday"), "event_type", F.lit("home").alias("page"), "product_id", "device", "traffic_source").write.json(f"{root}/website_events")
    out = None
    for name, columns in (("orders", ["order_date", "total_amount"]), ("website_events", ["event_timestamp"])):
        rows, rejected = io.read_checked(spark, f"{root}/{name}", name)
        counted = rows.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column", "kept")
        part = rejected.groupBy("dataset", "column", "value").agg(F.count("*").alias("rejected"), F.countDistinct("key").alias("keys")).join(counted, "column")
        out = part if out is None else out.unionByName(part)
    return out


_BAD = lambda n, c, v, salt, key, share, s: f"select '{n}' dataset, '{c}' \"column\", '{v}' as value, count(*) filter ({b(salt, key)}<{share}) rejected, count(distinct {key}) filter ({b(salt, key)}<{share}) keys, count({c}) filter ({b(salt, key)}>={share}) kept from {s}"
_add("SRC1_rejected", _rejected, " union all ".join((_BAD("orders", "order_date", "soon", "when", "order_id", 100, "d_orders"), _BAD("orders", "total_amount", "n/a", "word", "order_id", 150, "d_orders"), _BAD("website_events", "event_timestamp", "yesterday", "when", "event_id::varchar", 100, "d_events"))))
_add("SRC7_files", lambda g: io.sources_under(g.tables.spark, _raw_files(g, ("payments",), ("products",))), " union all ".join(f"select '{n}' dataset, case when '{n}'='payments' then 'missing' when '{n}'='products' or count(*)=0 then 'empty' else 'present' end status from {s}" for n, s in DIRTY.items()))
QUERIES["RAW_Q02"] = lambda spark, folder: reports.top_products(_from_raw(Gold(Tables(spark, folder))))
QUERIES["RAW_Q19"] = lambda spark, folder: reports.profitability(_from_raw(Gold(Tables(spark, folder))))
QUERIES["RAW_profile"] = lambda spark, folder: _plain(_from_raw(Gold(Tables(spark, folder))).profile)
for _id in ("Q02", "Q19"):
    ORACLES[f"RAW_{_id}"] = sql_cleaned(_Q[_id])
ORACLES["RAW_profile"] = sql_cleaned(f"select * replace ({_CASTS}) from g_profile")
