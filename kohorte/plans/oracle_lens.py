"""The logical tables as DuckDB common table expressions, for the oracle queries only."""

from __future__ import annotations

import re

CODE = """case {0} when 0 then 'US' when 1 then 'AU' when 2 then 'CA' when 3 then 'BR' when 4 then 'GB' when 5 then 'FR'
 when 6 then 'ES' when 7 then 'DE' when 8 then 'IT' else 'X' || {0} end"""
CARD = f"case when {{0}} % 17 = 0 then null when {{0}} % 25 = 4 then 'UK' else {CODE.format('({0} % 25)')} end"

VIEWS = {
    "value_window": f"""
        select {CODE.format('n')} as country, case when q > date '1995-03-31' then q end as valid_from,
               case when q < date '2001-07-01' then cast(q + interval 3 months as date) - cast(1 + n % 5 as integer) end as valid_to,
               40 + n + (year(q) - 1995) * 4 + quarter(q) as value
        from (select distinct cast(date_trunc('quarter', o_orderdate) as date) as q from orders), range(25) r(n)
        where (n + quarter(q)) % 4 <> 0""",
    "ord": """
        select o_orderkey as k, o_custkey as cust, o_custkey * 5 + cast(left(o_orderpriority, 1) as int) - 1 as sub,
               case when o_orderstatus = 'P' then 0 else 1 end as ok, o_orderdate as done_at,
               row_number() over (partition by o_custkey * 5 + cast(left(o_orderpriority, 1) as int) - 1,
                                  o_orderstatus = 'P' order by o_orderdate, o_orderkey) as seq
        from orders""",
    "ret": """
        select l_orderkey as k, max(l_shipdate) as back from lineitem
        where l_returnflag = 'R' and l_linenumber = 1 group by l_orderkey""",
    "pay": """
        select k, cust, sub, ok, done_at, 0 as kind, ok = 1 and (seq = 1 or (seq = 2 and sub % 13 = 4)) as opening,
               ok = 1 and exists (select 1 from ret where ret.k = ord.k) as returned from ord
        union all
        select k, cust, sub, ok, greatest(done_at, back), 1, ok = 1 and (seq = 1 or (seq = 2 and sub % 13 = 4)), true from ord join ret using (k) where ok = 1""",
    "txn": """
        select k * 2 + kind as id, case kind when 0 then 'ch_' else 're_' end || k as id_transaction, cust as customer_id,
               sub as subscription_id, cust as user_agent_id, k % 4 as utms_id, k % 3 as mid_id, kind as transaction_type,
               ok as transaction_status,
               cast(case when opening then 0.95 when sub % 3 = 0 then 29.95 when sub % 3 = 1 then 39.95 else 49.95 end
                    as decimal(10,2)) as amount,
               case sub % 5 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' when 3 then 'CAD' else 'AUD' end as currency,
               case k % 3 when 0 then 'card' when 1 then 'wallet' end as apm_type, done_at as created_at, done_at as payment_date
        from pay""",
    "txn_dup": """
        select * from txn
        union all
        select * replace (payment_date - interval 1 day as payment_date) from txn where id % 10 = 0""",
    "inv": """
        select id as transaction_id, 'INV-' || id as invoice_number
        from (select distinct unnest([l_orderkey * 2, l_orderkey * 2 + 1]) as id from lineitem)""",
    "plan": """
        select i as id, cast(case i % 3 when 0 then 29.95 when 1 then 39.95 else 49.95 end as decimal(10,2)) as amount,
               cast(0.95 as decimal(10,2)) as amount_trial,
               case i % 5 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' when 3 then 'CAD' else 'AUD' end as currency,
               'plan_' || i as name
        from range(15) r(i)""",
    "subs": """
        select sub as id, cust as customer_id_np, sub % 4 as product_id, sub % 15 as subscription_type_id,
               case when max(done_at) filter (where ok = 1) is null then 'Registered' when sub % 10 < 4 then 'Unsuscribed'
                    else 'Active' end as subscription_status,
               min(done_at) as created_at,
               case when sub % 10 < 4 then max(done_at) filter (where ok = 1) + interval 20 days end as requested_unsubscribed_date,
               case when sub % 10 < 3 then max(done_at) filter (where ok = 1) + interval 30 days end as unsubscribed_date
        from ord group by sub, cust""",
    "cust": f"""
        select c_custkey as id,
               case when c_custkey % 50 = 3 then null when c_custkey % 20 = 7 then 'qa' || c_custkey || '@internal.test'
                    when c_custkey % 4 = 0 then 'u' || c_custkey || '@gmail.com'
                    else 'u' || c_custkey || '@firm' || c_nationkey || '.com' end as email,
               case when c_custkey % 25 = 11 then null else {CODE.format('c_nationkey')} end as ip_country,
               timestamp '1995-01-01' + to_days(cast(c_custkey % 2000 as int)) as created_at
        from customer""",
    "ext": "select * from cust where email not like '%internal%'",
    "ua": f"""
        select c_custkey as id, case c_custkey % 3 when 0 then 'Desktop' when 1 then 'Mobile' end as device,
               {CODE.format('((c_nationkey + 1) % 25)')} as country
        from customer""",
    "utm": """
        select * from (values (0, 'pdf free'), (1, 'editor GRATIS'), (2, 'gratuit pdf'), (3, null)) v(id, utm_term)""",
    "spend": f"""
        select cast(l_shipdate as date) as date, case s_nationkey when 4 then 'UK' else {CODE.format('s_nationkey')} end as geo,
               case when l_suppkey % 2 = 0 then 'web' else 'pdf' end as project_id,
               sum(cast(l_quantity as decimal(18,2))) as costs
        from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3""",
    "fx": """
        select date, code, cast(1 + i * 0.1 + day(date) * 0.01 as decimal(10,4)) as rate
        from (select distinct cast(o_orderdate as date) as date from orders),
             (values (0, 'EUR'), (1, 'USD'), (2, 'GBP'), (3, 'CAD'), (4, 'AUD')) c(i, code)""",
    "names": f"""
        select n_name as country_name, {CODE.format('n_nationkey')} as country_iso_2 from nation
        union all select n_name, 'UK' from nation where n_nationkey = 4""",
    "iso": """
        select lower(trim(country_name)) as c_name,
               case when bool_or(country_iso_2 = 'UK') then 'GB' else max(country_iso_2) end as iso
        from names group by 1""",
    "ev": """
        select ts - interval 8766 days as event_time,
               case when event_id % 3 = 2 and event_type = 'view' then 'view_page'
                    else case event_type when 'view' then 'landing_page_viewed' when 'click' then 'upload_document'
                         when 'signup' then 'sign_up' when 'purchase' then 'payment_page_viewed'
                         when 'error' then 'initial_purchase_event' end end as event_type,
               user_id as amplitude_id, ' ' || n_name as country,
               case event_id % 3 when 0 then 'editor' when 1 then 'web' else 'mobile' end as project_id,
               case when event_id % 10 = 9 then 'dev' else 'prod' end as environment,
               '{"charge_id": "ch_' || json_extract_string(props, '$.k') || '", "page_name": "'
                 || case when event_id % 2 = 0 then 'tool_page' else 'home' end || '"}' as event_properties
        from events join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey""",
    "located": """
        select ev.*, cast(event_time as date) as date, iso,
               case when upper(trim(coalesce(iso, country))) = 'UK' then 'GB'
                    else coalesce(upper(trim(coalesce(iso, country))), 'UNKNOWN') end as place
        from ev left join iso on lower(trim(country)) = c_name
        where environment = 'prod' and cast(event_time as date) >= date '1995-01-01'""",
    "acq": """
        select json_extract_string(event_properties, '$.charge_id') as charge_id, min(place) as place
        from located where event_type = 'initial_purchase_event' group by 1""",
    "mov": f"""
        select cast(done_at as date) as date, case kind when 1 then 'refund' else 'charge' end as event_type,
               case when kind = 1 then 'refund' when opening then 'initial_purchase' else 'renewal' end as event_subtype,
               'ch_' || k as charge_id, 'cus_' || cust as customer_id, 'sub_' || sub as subscription_id,
               case when opening then 0 else 1 + k % 12 end as recurrence_cycle,
               cast(case kind when 1 then -1 else 1 end * (case when opening then 0.95 when sub % 3 = 0 then 29.95
                    when sub % 3 = 1 then 39.95 else 49.95 end) as decimal(18,2)) as gross_amount,
               case k % 3 when 0 then 'card' when 1 then 'wallet' end as payment_method_type,
               case when k % 2 = 0 then 'debit' else 'credit' end as card_funding,
               {CARD.format('cust')} as card_address_country, 'm' || (sub % 7) as merchant_id,
               case ok when 1 then 'succeeded' else 'failed' end as status
        from pay""",
    "pcust": "select 'cus_' || id as id, email from cust",
    "led_all": """
        select m.*, case when coalesce(place, card_address_country, 'UNKNOWN') = 'UK' then 'GB'
                         else coalesce(place, card_address_country, 'UNKNOWN') end as ip_country,
               case when merchant_id in ('m0', 'm1') then 'A' when merchant_id in ('m2', 'm3', 'm4') then 'B' else 'C' end as site
        from mov m left join acq using (charge_id)
        where status = 'succeeded' and date >= date '1995-01-01'""",
    "led": """
        select l.*, c.email from led_all l join pcust c on c.id = l.customer_id and c.email not like '%internal%'""",
    "file": """
        select p_partkey as id,
               ['pdf','PDF','docx','DOCX','csv','CSV','jpg','JPEG','png','ppt','xlsx','XLS'][p_partkey % 12 + 1] as file_format,
               case p_partkey % 3 when 0 then p_size || 'MB' when 1 then (p_size * 10) || 'KB' else p_size || 'mb' end as file_size,
               timestamp '1995-01-01' + to_days(cast(p_partkey % 2000 as int)) as created_at
        from part""",
    "rev": """
        select doc_id, email, 1 + doc_id % 5 as rating, text as comment,
               timestamp '1998-01-01' + to_days(cast(doc_id % 900 as int)) as created_at
        from documents left join cust on cust.id = doc_id % (select count(*) from customer)""",
    # transactions with what reports ask of them
    "good": """
        select t.*, cast(t.created_at as date) as date, i.invoice_number from txn t
        left join inv i on i.transaction_id = t.id where t.transaction_status = 1""",
    "billed": "select * from good where invoice_number is not null",
    "subprice": """
        select s.id as subscription_id, p.amount as price_amount, p.amount_trial as price_trial, p.currency as price_currency
        from subs s join plan p on p.id = s.subscription_type_id""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it mentions, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"(?:from|join|,)\s+{name}\b", text):
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql.strip()
    body = ",\n".join(f"{n} as ({known[n].strip()})" for n in ordered)
    own = sql.strip()
    if own.lower().startswith("with recursive "):
        return f"with recursive {body},\n{own[len('with recursive '):]}"
    if own.lower().startswith("with "):
        return f"with {body},\n{own[len('with '):]}"
    return f"with {body}\n{own}"
