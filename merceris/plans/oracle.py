"""The same queries as DuckDB SQL, for checking. Written apart from the DataFrame code."""

from __future__ import annotations

import re

AS_OF = "date '2001-09-01'"


def half_up(n: str, d: str, digits: int) -> str:
    s = 10**digits
    return f"(sign({n})*cast((abs(cast({n} as hugeint))*{2 * s}+nullif(cast({d} as hugeint),0))//(2*nullif(cast({d} as hugeint),0)) as double)/{s})"


def pct(n: str, d: str, digits: int = 2) -> str:
    return half_up(f"(100*({n}))", d, digits)


def usd(c: str) -> str:
    return f"(cast({c} as double)/100)"


def months(later: str, earlier: str) -> str:
    return f"((year({later})-year({earlier}))*12+month({later})-month({earlier})-(day({later})<day({earlier}))::int)"


def b(salt: str, key: str) -> str:
    return f"(('0x'||substr(md5('{salt}'||coalesce({key},'')),1,8))::bigint % 10000)"


def day(e: str) -> str:
    return f"cast(cast({e} as date) as varchar)"


EMAIL = r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'"

CTES = {
    "d_customers": """select 'CUST'||lpad(c_custkey::varchar,8,'0') customer_id, 'Customer' first_name, c_custkey::varchar last_name, 'c'||c_custkey::varchar||'@example.com' email,
        case c_custkey%3 when 0 then 'Male' when 1 then 'Female' else 'Other' end gender, date '1955-01-01'+(c_custkey*7919%18993)::int date_of_birth, n_name city, r_name province, 'Testland' country,
        date '1995-01-01'+(c_custkey*37%2400)::int registration_date, case when c_acctbal<0 then 'churned' when c_custkey%5=0 then 'inactive' else 'active' end customer_status
        from customer join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey""",
    "d_products": """select 'PROD'||lpad(p_partkey::varchar,8,'0') product_id, p_name||' #'||p_partkey::varchar product_name, p_type category, p_name subcategory, p_brand brand,
        round(p_retailprice::decimal(12,2)*0.6::decimal(3,2),2)::decimal(12,2) as cost, p_retailprice::decimal(12,2) selling_price from part""",
    "d_orders": """select 'ORD'||lpad(o_orderkey::varchar,8,'0') order_id, 'CUST'||lpad(o_custkey::varchar,8,'0') customer_id, o_orderdate order_date,
        case when o_orderkey%20=0 then 'refunded' when o_orderstatus='F' then 'completed' when o_orderstatus='P' then 'cancelled' else 'pending' end order_status, o_orderpriority payment_method, o_totalprice::decimal(14,2) total_amount from orders""",
    "d_items": """select 'L'||l_orderkey::varchar||'-'||l_linenumber::varchar order_item_id, 'ORD'||lpad(l_orderkey::varchar,8,'0') order_id, 'PROD'||lpad(l_partkey::varchar,8,'0') product_id, l_quantity::int quantity,
        (((round(l_extendedprice*100)::bigint//l_quantity::bigint)::decimal(12,0))*0.01::decimal(3,2))::decimal(12,2) unit_price, l_discount::decimal(5,4) discount from lineitem""",
    "d_payments": """select 'PAY'||o_orderkey::varchar payment_id, 'ORD'||lpad(o_orderkey::varchar,8,'0') order_id, (o_orderdate::date+(o_orderkey*7%4)::int)::timestamp payment_date, o_orderpriority payment_method,
        case when o_orderkey%20=0 then 'refunded' when o_orderstatus='F' then 'success' when o_orderstatus='P' then 'failed' else 'pending' end payment_status, (o_totalprice::decimal(14,2)+case when o_orderkey%50=0 then 1 else 0 end)::decimal(14,2) amount from orders""",
    "d_ev": "select *, cast(json_extract_string(props,'$.k') as bigint) k from events",
    "d_events": """select event_id, 'CUST'||lpad(user_id::varchar,8,'0') customer_id, user_id::varchar||'/'||ts::date::varchar session_id, ts event_timestamp, et event_type,
        case when et in ('product_view','add_to_cart','purchase') then 'PROD'||lpad(k::varchar,8,'0') end product_id, case user_id%4 when 0 then 'mobile' when 1 then 'desktop' when 2 then 'tablet' end device,
        case user_id%7 when 0 then 'organic_search' when 1 then 'paid_search' when 2 then 'social_media' when 3 then 'direct' when 4 then 'email' when 5 then 'affiliate' end traffic_source
        from (select *, case event_type when 'view' then 'product_view' when 'click' then 'add_to_cart' when 'signup' then 'checkout_start' when 'error' then 'page_view' else 'purchase' end et from d_ev)""",
    "d_tickets": """select event_id ticket_id, 'CUST'||lpad(user_id::varchar,8,'0') customer_id, ts created_at, case k%4 when 0 then 'delivery_delay' when 1 then 'product_defect' when 2 then 'refund_request' else 'general_inquiry' end issue_type,
        case when value>=100 then 'urgent' when value>=50 then 'high' when value>=20 then 'medium' else 'low' end priority, st status, case when st in ('resolved','closed') then value::decimal(10,2) end resolution_time
        from (select *, case event_id%4 when 0 then 'open' when 1 then 'in_progress' when 2 then 'resolved' else 'closed' end st from d_ev where event_type='error')""",
    "d_campaigns": """select 'CMP'||lpad(n_nationkey::varchar,3,'0') campaign_id, 'Campaign '||n_name campaign_name, case n_nationkey%3 when 0 then 'email' when 1 then 'social_media' else 'search_ads' end channel,
        date '2024-01-01' start_date, date '2024-01-01'+(n_nationkey+3)::int end_date, ((n_nationkey+1)*1000)::decimal(14,2) budget from nation where n_nationkey<=12""",
    "d_touches": """select event_id interaction_id, 'CMP'||lpad((k%12)::varchar,3,'0') campaign_id, 'CUST'||lpad(user_id::varchar,8,'0') customer_id,
        case event_type when 'view' then 'impression' when 'click' then 'click' else 'conversion' end interaction_type, ts interaction_timestamp from d_ev where event_type in ('view','click','purchase')""",
    "s_orders": "select o.*, (total_amount*100)::bigint amount, order_status='completed' done, order_date::date as d from d_orders o join (select customer_id from d_customers) using (customer_id)",
    "s_items": "select *, round(quantity*unit_price*(1-discount),2)::decimal(14,2) line_amount from d_items",
    "s_lines": """select i.order_id, o.customer_id, o.done, o.d, p.product_id, p.product_name, p.category, i.quantity, (i.line_amount*100)::bigint line, (i.quantity*i.unit_price*100)::bigint gross, (p.cost*100)::bigint unit_cost
        from s_items i join s_orders o using (order_id) join d_products p using (product_id)""",
    "c_orders": f"""select customer_id, count(*) total_orders, count(*) filter (done) completed_orders, count(*) filter (order_status='cancelled') cancelled_orders,
        coalesce(sum(amount) filter (done),0)::bigint spend, min(d) filter (done) first_purchase_date, max(d) filter (done) last_purchase_date from s_orders group by 1""",
    "c_product": """select customer_id, product_name favorite_product from (select customer_id, product_name, row_number() over (partition by customer_id order by count(*) desc, sum(quantity) desc, product_name, category) r
        from s_lines group by customer_id, category, product_name) where r=1""",
    "c_category": "select customer_id, category favorite_category from (select customer_id, category, row_number() over (partition by customer_id order by sum(quantity) desc, category) r from s_lines group by 1,2) where r=1",
    "c_web": "select customer_id, count(distinct session_id) website_sessions, count(*) website_events from d_events group by 1",
    "c_tickets": f"select customer_id, count(*) support_tickets, count(*) filter (status in ('resolved','closed')) resolved_tickets, {half_up('sum((resolution_time*100)::bigint)', '(count(resolution_time)*100)', 2)} average_resolution_time from d_tickets group by 1",
    "c_touches": "select customer_id, count(*) campaign_interactions from d_touches group by 1",
    "base": f"""select c.customer_id, c.first_name||' '||c.last_name customer_name, {months(AS_OF, 'date_of_birth')}//12 age, gender, city||', '||province as location, province, registration_date,
        coalesce(total_orders,0) total_orders, coalesce(completed_orders,0) completed_orders, coalesce(cancelled_orders,0) cancelled_orders, coalesce(spend,0) spend,
        coalesce({half_up('spend', '(completed_orders*100)', 2)},0) average_order_value, first_purchase_date, last_purchase_date, date_diff('day', last_purchase_date, {AS_OF}) days_since_last_purchase,
        coalesce({half_up('completed_orders', f'greatest({months(AS_OF, "first_purchase_date")},1)', 4)},0) purchase_frequency, favorite_category, favorite_product, coalesce(website_sessions,0) website_sessions, coalesce(website_events,0) website_events,
        coalesce(support_tickets,0) support_tickets, coalesce(resolved_tickets,0) resolved_tickets, average_resolution_time, coalesce(campaign_interactions,0) campaign_interactions
        from d_customers c left join c_orders using (customer_id) left join c_product using (customer_id) left join c_category using (customer_id) left join c_web using (customer_id) left join c_tickets using (customer_id) left join c_touches using (customer_id)""",
    "stats": f"select c.customer_id, registration_date, date_diff('day', last_purchase_date, {AS_OF}) recency_days, coalesce(completed_orders,0) frequency, coalesce(spend,0) spend from d_customers c left join c_orders using (customer_id)",
    "scored": """select *, ntile(5) over (order by recency_days desc, customer_id) r_score, ntile(5) over (order by frequency, customer_id) f_score, ntile(5) over (order by spend, customer_id) m_score from stats where frequency>0
        union all select *, 1, 1, 1 from stats where frequency=0""",
    "g_rfm": f"""select *, r_score::varchar||f_score||m_score rfm_score, r_score+f_score+m_score rfm_sum, case
        when frequency=0 then case when registration_date>={AS_OF}-90 then 'New Customers' else 'Lost Customers' end
        when least(r_score,f_score,m_score)>=4 then 'Champions' when f_score>=4 then case when r_score>=3 then 'Loyal Customers' else 'Can''t Lose Them' end
        when r_score<=2 then case when f_score>=2 then 'At Risk' else 'Lost Customers' end
        when r_score>=4 then case when f_score>=2 then 'Potential Loyalists' else 'New Customers' end
        when f_score<=2 then 'Promising' else 'Need Attention' end customer_segment from scored""",
    "g_profile": "select base.*, rfm_score, customer_segment from base left join g_rfm using (customer_id)",
    "cm": "select distinct customer_id, date_trunc('month', d)::date as m from s_orders where done",
    "fm": "select customer_id, min(m) f from cm group by 1",
    "spine": f"select unnest(generate_series((select min(m) from cm), greatest((select max(m) from cm), date_trunc('month',{AS_OF})::date), interval 1 month))::date as m",
    "act": "select s.m, count(distinct cm.customer_id) a, count(distinct cm.customer_id) filter (fm.f=s.m) n from spine s left join cm on cm.m=s.m left join fm on fm.customer_id=cm.customer_id group by 1",
    "ret": "select x.m, count(*) k from cm x join cm y on x.customer_id=y.customer_id and y.m=(x.m - interval 1 month)::date group by 1",
    "rev": "select date_trunc('month', d)::date as m, sum(amount)::bigint r from s_orders where done group by 1",
    "g_month": f"""select act.m, act.a, act.n, {half_up('coalesce(k,0)', 'p.a', 4)} retention_rate, {half_up('(p.a-coalesce(k,0))', 'p.a', 4)} churn_rate, {half_up('(act.a-act.n)', 'act.a', 4)} repeat_purchase_rate, coalesce(r,0) r
        from act left join act p on p.m=(act.m - interval 1 month)::date left join ret on ret.m=act.m left join rev on rev.m=act.m""",
    "coh": "select f, ((year(m)-year(f))*12+month(m)-month(f))::bigint p, count(*) a from cm join fm using (customer_id) group by 1,2",
    "g_cohort": f"select c.f, c.p, c.a, z.a z, {half_up('c.a', 'z.a', 4)} retention_rate from coh c join coh z on z.f=c.f and z.p=0",
    "churn": "select coalesce(sum(round(churn_rate*10000)::bigint)::bigint, 10000) c, case when count(*)=0 then 60 else count(*) end n from g_month where churn_rate>0",
    "life": "select c, n, case when n*10000>c*60 then 60 else n*10000 end t, case when n*10000>c*60 then 1 else c end u from churn",
    "g_clv": f"""select customer_id, {usd('spend')} historical_clv, average_order_value, purchase_frequency, {half_up('t', 'u', 2)} estimated_lifespan_months,
        {half_up('(round(average_order_value*100)::hugeint*round(purchase_frequency*10000)::bigint*t)', '(u::hugeint*1000000)', 2)} estimated_clv from base, life""",
    "flags": """select session_id, max((event_type='page_view')::int) seen, max((event_type='product_view')::int) viewed_product, max((event_type='add_to_cart')::int) added_to_cart, max((event_type='checkout_start')::int) started_checkout, max((event_type='purchase')::int) purchased from d_events group by 1""",
    # dirty variants
    "x_customers0": f"select * replace (case when {b('mail', 'customer_id')}<200 then replace(email,'@','_at_') else email end as email) from d_customers",
    "x_customers": f"select * replace (case when {b('lost', 'customer_id')}<50 then null else customer_id end as customer_id) from (select * from x_customers0 union all select * from x_customers0 where {b('twice', 'customer_id')}<100)",
    "x_products": f"select * replace (case when {b('swap', 'product_id')}<67 then selling_price else cost end as cost, case when {b('swap', 'product_id')}<67 then cost else selling_price end as selling_price) from d_products",
    "x_orders0": f"""select * replace (case when {b('stray', 'order_id')}<200 then 'CUST'||(9000000+{b('stray', 'order_id')})::varchar else customer_id end as customer_id,
        case when {b('state', 'order_id')}<100 then null else order_status end as order_status, case when {b('minus', 'order_id')}<100 then -abs(total_amount) else total_amount end as total_amount) from d_orders""",
    "x_orders": f"select * from x_orders0 union all select * from x_orders0 where {b('twice', 'order_id')}<67",
    "x_items": f"select * replace (case when {b('stray', 'order_item_id')}<200 then 'PROD'||(9000000+{b('stray', 'order_item_id')})::varchar else product_id end as product_id, case when {b('minus', 'order_item_id')}<67 then -abs(unit_price) else unit_price end as unit_price) from d_items",
    "x_payments": f"select * replace (case when {b('state', 'payment_id')}<100 then null else payment_status end as payment_status, case when {b('minus', 'payment_id')}<67 then -abs(amount) else amount end as amount) from d_payments",
    "x_events": f"select * replace (event_id::varchar as event_id, case when {b('who', 'event_id::varchar')}<67 then null else customer_id end as customer_id, case when {b('what', 'event_id::varchar')}<50 then null else event_type end as event_type) from d_events",
    "x_tickets": f"select * replace (ticket_id::varchar as ticket_id, case when {b('issue', 'ticket_id::varchar')}<67 then null else issue_type end as issue_type, case when {b('who', 'ticket_id::varchar')}<50 then null else customer_id end as customer_id) from d_tickets",
    "x_touches": f"select * replace (interaction_id::varchar as interaction_id, case when {b('who', 'interaction_id::varchar')}<67 then null else customer_id end as customer_id) from d_touches",
    # cleaned
    "k_customers": f"""select distinct on (customer_id) customer_id, first_name, last_name, case when regexp_matches(email,{EMAIL}) then email end email, gender, case when date_of_birth between date '1930-01-01' and date '2015-12-31' then date_of_birth end date_of_birth, city, province, country,
        case when registration_date between date '1990-01-01' and date '2030-12-31' then registration_date end registration_date, customer_status, coalesce(regexp_matches(email,{EMAIL}),false) is_valid_email from x_customers where customer_id is not null""",
    "k_products": "select * replace (case when cost<=selling_price then cost end as cost, case when cost<=selling_price then selling_price end as selling_price) from x_products",
    "k_orders": "select distinct order_id, customer_id, order_date, order_status, payment_method, case when total_amount>=0 then total_amount end total_amount from x_orders where customer_id in (select customer_id from k_customers)",
    "k_items0": "select * exclude (t) from (select *, row_number() over (partition by order_item_id order by order_id, product_id, quantity, unit_price, discount) t from x_items) where t=1",
    "k_items": "select * replace (case when unit_price>=0 then unit_price end as unit_price) from k_items0 where order_id in (select order_id from k_orders) and product_id in (select product_id from k_products)",
    "k_payments": "select * replace (case when amount>=0 then amount end as amount) from x_payments where order_id in (select order_id from k_orders)",
    "k_tickets0": "select * exclude (t) from (select *, row_number() over (partition by ticket_id order by customer_id, created_at, issue_type, priority, status, resolution_time) t from x_tickets) where t=1",
    "k_tickets": "select * from k_tickets0 where customer_id in (select customer_id from k_customers)",
    "k_touches0": "select * exclude (t) from (select *, row_number() over (partition by interaction_id order by campaign_id, customer_id, interaction_type, interaction_timestamp) t from x_touches) where t=1",
    "k_touches": "select * from k_touches0 where campaign_id in (select campaign_id from d_campaigns) and customer_id in (select customer_id from k_customers)",
    "k_events0": "select * exclude (t) from (select *, row_number() over (partition by event_id order by customer_id, session_id, event_timestamp, event_type, product_id, device, traffic_source) t from x_events) where t=1",
    "k_events": "select * from k_events0 where customer_id in (select customer_id from k_customers)",
    # surrogate keys
    "w_customers": "select row_number() over (order by customer_id) customer_key, * from d_customers",
    "w_products": "select row_number() over (order by product_id) product_key, *, case when selling_price>0 then round((selling_price-cost)/selling_price,4) end margin_pct from d_products",
    "w_orders": "select row_number() over (order by order_id) order_key, * from d_orders",
    "w_campaigns": "select row_number() over (order by campaign_id) campaign_key, * from d_campaigns",
    "w_places": "select row_number() over (order by country, province, city) location_key, * from (select distinct city, province, country from d_customers)",
    "w_devices": "select * from (values (1,'mobile'),(2,'desktop'),(3,'tablet'),(4,'Unknown')) t(device_key, device_name)",
}


def sql(body: str) -> str:
    """``body`` behind just those CTEs that it needs, in their order."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in set(re.findall(r"\b\w+\b", text)) & CTES.keys() - needed:
            needed.add(name)
            add(CTES[name])

    add(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n]})" for n in CTES if n in needed) + "\n" + body


def sql_cleaned(body: str) -> str:
    """``sql`` over the cleaned tables: every CTE but those of raw, damaged and cleaned tables reads k_ in place of d_."""

    def moved(text: str) -> str:
        return re.sub(r"\bd_(customers|products|orders|items|payments|events|tickets|touches)\b", r"k_\1", text)

    needed: set[str] = set()
    texts = {n: t if n[:2] in ("d_", "x_", "k_") else moved(t) for n, t in CTES.items()}

    def add(text: str) -> None:
        for name in set(re.findall(r"\b\w+\b", text)) & texts.keys() - needed:
            needed.add(name)
            add(texts[name])

    add(moved(body))
    # cleaned tables stand after those that read them here, so the order is that of what they need
    order: list[str] = []

    def put(name: str) -> None:
        for other in sorted(set(re.findall(r"\b\w+\b", texts[name])) & needed - {name}):
            if other not in order:
                put(other)
        if name not in order:
            order.append(name)

    for name in sorted(needed):
        put(name)
    return "with " + ",\n".join(f"{n} as materialized ({texts[n]})" for n in order) + "\n" + moved(body)
