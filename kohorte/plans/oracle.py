"""DuckDB statements that compute the registered queries row by row over the driver tables.

They are written the plain way (row-level joins and windows), unlike the Spark plans, so that
agreement means something.
"""

from __future__ import annotations

from kohorte.functions import constants as k
from kohorte.plans.oracle_lens import with_views

AS_OF = "date '2001-08-01'"


def cents(x: str) -> str:
    return f"cast(round(cast(({x}) as decimal(28,6)), 2) as double)"


def units(x: str) -> str:
    return f"cast(round(cast(({x}) as decimal(28,6)), 0) as bigint)"


def cases(column: str, table: dict, default) -> str:
    arms = " ".join(f"when '{key}' then {value}" for key, value in table.items())
    return f"cast(case {column} {arms} else {default} end as double)"


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


FX = f"""case price_currency {' '.join(f"when '{c}' then {r}" for c, r in k.STATIC_FX.items())} else {k.STATIC_FX_DEFAULT} end"""
FREE = "case when utm_term ilike '%free%' or utm_term ilike '%gratis%' or utm_term ilike '%gratuit%' then 'free' else 'other' end"
NET = "sum(case transaction_type when 0 then amount when 1 then -amount else 0 end)"
SPAN = """strftime(date_trunc('week', date), '%d') || '-' || strftime(date_trunc('week', date) + interval 6 days, '%d %b %Y')
 || ' (W' || lpad(cast(week(date) as varchar), 2, '0') || ')'"""

Q: dict[str, str] = {}
VIEW: dict[str, str] = {}

# ------------------------------------------------------------------- counters
Q["sales_daily"] = f"""
select b.date, ip_country, count(*) as n_sales from billed b join ext on ext.id = b.customer_id
where transaction_type = 0 and amount < 10 and b.date < {AS_OF} group by all"""

Q["registers_daily"] = f"""
select cast(created_at as date) as created_at_register, ip_country, count(*) as n_registers from ext
where cast(created_at as date) between date '1995-01-01' and {AS_OF} group by all"""

Q["status_counts"] = """
select subscription_status, count(*) as total from txn t join subs s on s.id = t.subscription_id
join ext on ext.id = s.customer_id_np
where transaction_status = 1 and transaction_type = 0 and amount < 5 group by all"""

Q["active_subs_no_refund"] = """
select subscription_status, count(*) as total from billed t join subs s on s.id = t.subscription_id
join ext on ext.id = s.customer_id_np
where transaction_type = 0 and amount < 10
  and s.id not in (select subscription_id from billed where transaction_type = 1) group by all"""

Q["sales_revenue_daily"] = f"""
select b.date, ip_country, year(b.date) || '-W' || week(b.date) as week,
       {cases('ip_country', k.COUNTRY_LTV, k.COUNTRY_LTV_DEFAULT)} as ltv,
       count(*) filter (where transaction_type = 0 and price_trial = amount) as sales,
       {units(NET)} as user_revenue, count(*) filter (where transaction_type = 1) as refunds,
       {units("coalesce(sum(amount) filter (where transaction_type = 1), 0)")} as amount_refunds
from billed b join ext on ext.id = b.customer_id left join subprice using (subscription_id)
where b.date >= date '1995-01-01' group by b.date, ip_country"""

Q["file_size_mix"] = f"""
select case when file_format in ('DOC', 'doc', 'docx') then 'doc' when file_format = 'CSV' then 'csv'
            when lower(file_format) in ('jpg', 'jpeg') then 'jpg' when lower(file_format) = 'pdf' then 'pdf'
            when lower(file_format) = 'png' then 'png' when lower(file_format) in ('ppt', 'pptx') then 'ppt'
            when file_format in ('xls', 'xlsx') then 'excel' else 'others' end as file_format,
       count(*) as n_files,
       {cents("avg(cast(left(file_size, length(file_size) - 2) as double) / case when file_size ilike '%KB' then 1024 else 1 end)")}
         as avg_size_mb
from file where created_at between timestamp '1995-01-01' and timestamp '2000-03-01' group by 1"""

Q["reviews_export"] = """
select cast(r.created_at as date) as created_at, cast(null as varchar) as a, cast(null as varchar) as a2, r.email, r.rating,
       replace(replace(r.comment, chr(10), ' '), chr(13), ' ') as comment, s.subscription_status,
       'plan_' || s.subscription_type_id as name
from rev r left join cust c on c.email = r.email
left join (select * from subs qualify row_number() over (partition by customer_id_np order by created_at desc, id desc) = 1) s
  on s.customer_id_np = c.id
where r.created_at > timestamp '1998-01-02' and (r.email not like '%internal%' or r.email not like '%test%')"""

Q["recurrence_per_sub"] = f"""
select i.subscription_id as id, ip_country, i.date as initial_purchase_date, cast(price_amount as double) as amount,
       count(*) - 1 as n_recurrences
from billed i join ext on ext.id = i.customer_id join subprice using (subscription_id)
join billed t on t.subscription_id = i.subscription_id and t.transaction_type = 0
where i.transaction_type = 0 and i.amount < 5 and i.date > date '1995-01-01'
  and i.created_at < {AS_OF} - interval 8 days group by all"""

Q["dedup_latest_txn"] = """
select id, id_transaction, customer_id, subscription_id, user_agent_id, utms_id, mid_id,
       cast(transaction_type as bigint) as transaction_type, cast(transaction_status as bigint) as transaction_status,
       cast(amount as double) as amount, currency, apm_type, cast(created_at as date) as created_at,
       cast(payment_date as date) as payment_date
from txn_dup qualify row_number() over (partition by id order by payment_date desc) = 1"""

# -------------------------------------------------------------------- cohorts
VIEW["trial"] = """
    select b.subscription_id, b.date, ip_country from billed b join ext on ext.id = b.customer_id
    where transaction_type = 0 and amount < 5 and b.date > date '1995-01-01'"""

Q["cohort_renewals"] = f"""
select date, ip_country, {SPAN} as week, count(*) as sales, cast(sum(net) as bigint) as revenue,
       count(*) filter (where again > 0) as renewal, count(*) filter (where again > 1) as renewal_2,
       cast(sum(refunds) as bigint) as refunds
from (select i.subscription_id, i.date, ip_country, {units(NET)} as net,
             count(*) filter (where transaction_type = 0 and amount > 5)
               - count(*) filter (where transaction_type = 1 and amount > 5) as again,
             count(*) filter (where transaction_type = 1) as refunds
      from trial i join billed t on t.subscription_id = i.subscription_id group by 1, 2, 3)
group by 1, 2"""

Q["renewal_windows"] = f"""
with mark as (
  select subscription_id, min(created_at) filter (where n = 1) as r1, min(created_at) filter (where n = 2) as r2,
         min(created_at) filter (where n = 3) as r3
  from (select subscription_id, created_at, row_number() over (partition by subscription_id order by created_at, id) as n
        from good where transaction_type = 0 and amount > 5) group by 1),
one as (
  select i.subscription_id, i.date, i.ip_country,
         count(*) filter (where transaction_type = 0 and amount > 5)
           - count(*) filter (where transaction_type = 1 and amount > 5) as again,
         bool_or(req < coalesce(r1, timestamp '9999-01-01')) as q1,
         bool_or(req >= r1 and req < coalesce(r2, timestamp '9999-01-01')) as q2,
         bool_or(req >= r2 and req < coalesce(r3, timestamp '9999-01-01')) as q3,
         bool_or(transaction_type = 1 and t.created_at < coalesce(r1, timestamp '9999-01-01')) as f1,
         bool_or(transaction_type = 1 and t.created_at >= r1 and t.created_at < coalesce(r2, timestamp '9999-01-01')) as f2,
         bool_or(transaction_type = 1 and t.created_at >= r2 and t.created_at < coalesce(r3, timestamp '9999-01-01')) as f3
  from trial i join (select id as subscription_id, requested_unsubscribed_date as req from subs) s using (subscription_id)
  left join mark m on m.subscription_id = i.subscription_id join billed t on t.subscription_id = i.subscription_id
  group by 1, 2, 3)
select date, ip_country, {SPAN} as week, count(*) as sales,
       count(*) filter (where again > 0) as renewal_1, count(*) filter (where again > 1) as renewal_2,
       count(*) filter (where again > 2) as renewal_3, count(*) filter (where q1) as req_before_r1,
       count(*) filter (where q2) as req_before_r2, count(*) filter (where q3) as req_before_r3,
       count(*) filter (where f1) as ref_before_r1, count(*) filter (where f2) as ref_before_r2,
       count(*) filter (where f3) as ref_before_r3
from one group by 1, 2"""


# -------------------------------------------------------------------- payback
def valued(dims: dict[str, str], below: int, joins: str = "") -> str:
    made = ", ".join(f"{expr} as {name}" for name, expr in dims.items())
    return f"""
    select i.subscription_id, cohort_date, {', '.join(dims)}, trial, recurring,
           count(*) filter (where t.transaction_type = 0 and t.amount > 5)
             - count(*) filter (where t.transaction_type = 1 and t.amount > 5) as again
    from (select b.subscription_id, b.date as cohort_date, {made}, price_trial * {FX} as trial, price_amount * {FX} as recurring
          from billed b join ext on ext.id = b.customer_id join subprice using (subscription_id) {joins}
          where b.transaction_type = 0 and b.amount < {below} and b.date >= date '1995-01-01') i
    join billed t on t.subscription_id = i.subscription_id group by all"""


VIEW["val"] = valued({"ip_country": "ext.ip_country"}, 5)
VIEW["val_dev"] = valued({"device": "coalesce(ua.device, 'Desktop')", "ip_country": "ua.country"}, 10,
                         "left join ua on ua.id = b.user_agent_id")
VIEW["val_key"] = valued({"keyword": FREE}, 10, "left join utm on utm.id = b.utms_id")
REAL = "case when again = 0 then trial when again = 1 then trial + recurring when again >= 2 then trial + 2 * recurring {} end"
VIEW["share"] = f"""
    select ip_country, count(*) as sample_size, count(*) filter (where again > 0) / count(*) as r1,
           count(*) filter (where again > 1) / count(*) as r2
    from val where cohort_date <= {AS_OF} - interval 45 days group by 1 having count(*) > 50"""
PREDICTED = "cast(trial as double) + recurring * coalesce(r1, 0) + recurring * coalesce(r2, 0)"
NINE = texts(k.PAYBACK_COUNTRIES)

Q["recurrence_ratios"] = "select * from share"

Q["payback_daily"] = f"""
select cohort_date, ip_country, count(*) as new_sales, {cents(f'sum({PREDICTED})')} as predicted_d35_revenue,
       {cents('sum(' + REAL.format('else 0') + ')')} as real_d35_revenue,
       {cents(f"sum(case when date_diff('day', cohort_date, {AS_OF}) > 37 then cast({REAL.format('')} as double) else {PREDICTED} end)")}
         as smart_d35_revenue
from val left join share using (ip_country) where ip_country in ({NINE}) group by 1, 2"""

Q["payback_weekly"] = f"""
with cost as (select date_trunc('week', date) as w, geo, sum(costs) as costs from spend where project_id = 'pdf' group by 1, 2)
select cast(date_trunc('week', cohort_date) as date) as cohort_week, ip_country, cast(costs as double) as costs,
       count(*) as new_sales, {cents(f'sum({PREDICTED})')} as predicted_d35_revenue,
       {cents('sum(' + REAL.format('else 0') + ')')} as real_d35_revenue,
       {cents(f"sum(case when date_diff('day', cohort_date, {AS_OF}) > 37 then {REAL.format('')} else 0 end)")} as smart_d35_revenue
from val left join share using (ip_country) left join cost on w = date_trunc('week', cohort_date) and geo = ip_country
where ip_country in ({NINE}) group by 1, 2, 3"""

Q["payback_by_device"] = f"""
select cohort_date, device, ip_country, count(*) as new_sales, {cents('sum(' + REAL.format('else 0') + ')')} as real_d35_revenue
from val_dev group by 1, 2, 3"""

Q["payback_by_keyword"] = f"""
select cohort_date, keyword, count(*) as new_sales, {cents('sum(' + REAL.format('else 0') + ')')} as real_d35_revenue
from val_key group by 1, 2"""

VIEW["opened"] = f"""
    select b.subscription_id, b.date as cohort_date, coalesce(ext.ip_country, ua.country) as ip_country, rate, {FREE} as keyword,
           'mid_' || b.mid_id as internal_mid_name, coalesce(b.apm_type, 'Null') as apm_type, ua.device
    from billed b join ext on ext.id = b.customer_id
    join subprice sp on sp.subscription_id = b.subscription_id and sp.price_trial = b.amount
    left join fx on fx.date = b.date and fx.code = b.currency left join ua on ua.id = b.user_agent_id
    left join utm on utm.id = b.utms_id
    where b.transaction_type = 0 and b.date >= date '1995-01-01'"""
VIEW["opened_txn"] = """
    select o.*, t.transaction_type as kind, t.amount, t.date as day, n, c, r
    from opened o left join (
        select *, row_number() over (partition by subscription_id, transaction_type order by created_at, id) as n,
               count(*) filter (where transaction_type = 0) over (partition by subscription_id) as c,
               count(*) filter (where transaction_type = 1) over (partition by subscription_id) as r
        from good) t on t.subscription_id = o.subscription_id"""
SIGNED = "case kind when 0 then amount when 1 then -amount else 0 end / nullif(rate, 0)"
EARLY = "case when kind = 0 and n <= 3 then amount when kind = 1 and day <= cohort_date + 37 then -amount else 0 end / nullif(rate, 0)"
PAID = f"""count(*) filter (where kind = 0) as charges, count(*) filter (where kind = 1) as refunds,
       {cents(f'sum({SIGNED})')} as real_revenue, {cents(f'sum({EARLY})')} as real_revenue_37d,
       count(distinct subscription_id) filter (where c - r > 1) as first_renewals"""
PAID_REPEAT = PAID.replace("count(*) filter (where kind = 0) as charges, count(*) filter (where kind = 1) as refunds",
                           "cast(sum(c) as bigint) as charges, cast(sum(r) as bigint) as refunds")

Q["cohort_revenue_eur"] = f"""
select cohort_date, ip_country, {cents('sum(amount / nullif(rate, 0))')} as total_amount,
       {cents(f'sum({SIGNED})')} as real_revenue from opened_txn group by 1, 2"""

Q["payback_by_method"] = f"""
select cohort_date as date, ip_country, internal_mid_name, apm_type, device, keyword,
       count(distinct subscription_id) as sales, {PAID} from opened_txn group by 1, 2, 3, 4, 5, 6"""

# Ranks and counts over transactions repeated for each trial of their subscription.
VIEW["opened_each"] = VIEW["opened"].replace("select b.subscription_id,", "select b.id as trial, b.subscription_id,", 1)
VIEW["repeated_txn"] = """
    select o.*, t.transaction_type as kind, t.amount, t.date as day,
           row_number() over (partition by o.subscription_id, t.transaction_type order by t.created_at, t.id, o.trial) as n,
           count(*) filter (where t.transaction_type = 0) over (partition by o.subscription_id) as c,
           count(*) filter (where t.transaction_type = 1) over (partition by o.subscription_id) as r
    from opened_each o left join good t on t.subscription_id = o.subscription_id"""
Q["payback_by_method_ranked"] = Q["payback_by_method"].replace("opened_txn", "repeated_txn")

# ------------------------------------------------------------- funnel, spend
STEPS = """count(distinct amplitude_id) filter (where event_type = 'landing_page_viewed') as landing_page_viewers,
       count(distinct amplitude_id) filter (where event_type = 'upload_document') as upload_document_users,
       count(distinct amplitude_id) filter (where event_type = 'sign_up') as sign_ups,
       count(distinct amplitude_id) filter (where event_type = 'payment_page_viewed') as payment_page_viewers"""

Q["funnel_daily"] = f"""
select date, coalesce(iso, country) as ip_country, {STEPS} from located where project_id in ('editor', 'web') group by 1, 2"""

Q["funnel_monthly"] = f"""
select cast(date_trunc('month', date) as date) as date, coalesce(iso, country) as ip_country, {STEPS}, true as merged_agrees
from located where project_id in ('editor', 'web') group by 1, 2"""
Q["funnel_streamed"] = Q["funnel_daily"]

VIEW["viewers"] = f"""
    select date, place as ip_country, 'B' as site, landing_page_viewers
    from (select date, place, {STEPS} from located where project_id in ('editor', 'web') group by 1, 2)
    union all
    select date, place, 'A', count(distinct case when event_type = 'view_page'
                 and json_extract_string(event_properties, '$.page_name') = 'tool_page' then amplitude_id end)
    from located where project_id = 'mobile' and event_type in ('view_page', 'begin_checkout', 'click', 'view') group by 1, 2"""
Q["funnel_by_site"] = "select * from viewers"
Q["country_mapping"] = "select c_name, iso from iso"

Q["spend_daily"] = f"""
select date, case geo when 'UK' then 'GB' else geo end as ip_country, {cents('sum(costs)')} as spend
from spend where project_id = 'pdf' and date >= date '1995-01-01' group by 1, 2"""
VIEW["site_spend"] = f"""
    select date, case geo when 'UK' then 'GB' else geo end as ip_country, case project_id when 'pdf' then 'B' else 'A' end as site,
           {cents('sum(costs)')} as spend
    from spend where date >= date '1995-01-01' group by 1, 2, 3"""
VIEW["site_spend_open"] = VIEW["site_spend"].replace("where date >= date '1995-01-01'", "where date >= date '1995-01-01' or project_id != 'pdf'")
Q["spend_by_site"] = "select * from site_spend"
Q["spend_by_site_open"] = "select * from site_spend_open"

# --------------------------------------------------------------------- ledger
Q["ledger_enriched"] = """
select date, event_type, subscription_id, event_subtype, recurrence_cycle, card_funding, ip_country,
       cast(gross_amount as double) as gross_amount, payment_method_type, site, charge_id, customer_id from led"""

Q["ledger_reconcile"] = """
select l.date, event_type, charge_id, l.customer_id as processor_customer_id, l.subscription_id as processor_subscription_id,
       event_subtype, recurrence_cycle, id_transaction, t.customer_id as customer_id_internal,
       cast(t.amount as double) as amount_internal, t.currency as currency_internal, email, ip_country,
       cast(gross_amount as double) as gross_amount, payment_method_type, invoice_number, site
from led l left join txn t on t.id_transaction = l.charge_id left join inv on inv.transaction_id = t.id"""

VIEW["net"] = """
    select s.*, n.net_revenue, n.net_cycles
    from (select subscription_id, min(date) as cohort_date, max(ip_country) as ip_country, max(site) as site,
                 max(card_funding) as card_funding from led_all
          where event_subtype = 'initial_purchase' and event_type = 'charge' group by 1) s
    join (select subscription_id, sum(gross_amount) as net_revenue,
                 count(*) filter (where event_type = 'charge') - count(*) filter (where event_type = 'refund') - 1 as net_cycles
          from led_all group by 1) n using (subscription_id)"""
Q["subscription_net"] = """
select subscription_id, cohort_date, ip_country, site, card_funding, cast(net_revenue as double) as net_revenue, net_cycles
from net"""


def pyramid() -> str:
    rev = [f"coalesce(sum(net_revenue) filter (where net_cycles >= {i}), 0)" for i in range(13)]
    cells = [f"count(*) filter (where net_cycles >= {i}) as r{i}, cast({rev[i]} as double) as rev_r{i}" for i in range(13)]
    nested = [f"{cents('cast(' + ' + '.join(rev[:i + 1]) + ' as double) / count(*)')} as ltv_r{i}" for i in range(4)]
    exact = [f"{cents(f'cast(coalesce(sum(net_revenue) filter (where net_cycles between 0 and {i}), 0) as double) / count(*)')} as ltv_r{i}_exact"
             for i in range(4)]
    return f"""
select cast(date_trunc('month', cohort_date) as date) as cohort_month, cohort_date, ip_country, net.site, count(*) as initial_sales,
       card_funding, coalesce(any_value(spend), 0) as spend, {', '.join(cells)}, {', '.join(nested)}, {', '.join(exact)}
from net left join site_spend s on s.date = cohort_date and s.ip_country = net.ip_country and s.site = net.site
where net.site in ('A', 'B') group by cohort_date, net.ip_country, net.site, card_funding""".replace(
        "cohort_date, ip_country, net.site,", "cohort_date, net.ip_country, net.site,", 1)


Q["recurrence_pyramid"] = pyramid()

VIEW["site_sales"] = """
    select date, ip_country, site, count(*) filter (where event_subtype = 'initial_purchase') as sales,
           cast(sum(gross_amount) as double) as user_revenue, count(*) filter (where event_type = 'refund') as refunds,
           cast(-coalesce(sum(gross_amount) filter (where event_type = 'refund'), 0) as double) as amount_refunds
    from led group by 1, 2, 3"""


def dated_ltv() -> str:
    arms = []
    for country, first, last, value in lens_ltv_windows():
        bounds = [f"ip_country = '{country}'"]
        bounds += [f"date >= date '{first}'"] if first else []
        bounds += [f"date <= date '{last}'"] if last else []
        arms.append(f"when {' and '.join(bounds)} then {value}")
    return f"cast(case {' '.join(arms)} else {k.DATED_LTV_DEFAULT} end as double)"


def lens_ltv_windows() -> list[tuple]:
    """The dated lifetime values moved 28 years back, into the years of the driver tables."""
    def moved(text):
        return text and f"{int(text[:4]) - 28}{text[4:]}"
    return [(c, moved(a), moved(b), v) for c, a, b, v in k.DATED_LTV]


Q["sales_by_site"] = "select * from site_sales"
Q["ltv_by_window"] = f"select date, ip_country, {dated_ltv()} as ltv from (select distinct date, ip_country from led)"
Q["ltv_by_window_table"] = f"""
    select d.date, d.ip_country, cast(coalesce(w.value, {k.DATED_LTV_DEFAULT}) as double) as ltv
    from (select distinct date, ip_country from led) d
    left join value_window w on w.country = d.ip_country and d.date between coalesce(w.valid_from, date '0001-01-01')
                                                                    and coalesce(w.valid_to, date '9999-12-31')"""

VIEW["site_opened"] = "select subscription_id, date as cohort_date, ip_country, site from led where event_subtype = 'initial_purchase'"
VIEW["site_txn"] = """
    select o.*, l.event_type, l.gross_amount, n, c, r
    from site_opened o left join (
        select *, row_number() over (partition by subscription_id, event_type order by date, charge_id) as n,
               count(*) filter (where event_type = 'charge') over (partition by subscription_id) as c,
               count(*) filter (where event_type = 'refund') over (partition by subscription_id) as r
        from led) l on l.subscription_id = o.subscription_id"""


def site_paid(repeat: bool) -> str:
    counts = ("cast(sum(c) as bigint) as charges, cast(sum(r) as bigint) as refunds" if repeat else
              "count(*) filter (where event_type = 'charge') as charges, count(*) filter (where event_type = 'refund') as refunds")
    return f"""
    select cohort_date, ip_country, site, {counts}, cast(sum(gross_amount) as double) as real_revenue,
           cast(coalesce(sum(gross_amount) filter (where n <= 3), 0) as double) as real_revenue_37d,
           count(distinct subscription_id) filter (where c - r > 1) as first_renewals
    from site_txn group by 1, 2, 3"""


Q["payback_by_site"] = site_paid(False)
VIEW["repeated_site_txn"] = """
    select o.*, l.event_type, l.gross_amount,
           row_number() over (partition by o.subscription_id, l.event_type order by l.date, l.charge_id, o.trial) as n,
           count(*) filter (where l.event_type = 'charge') over (partition by o.subscription_id) as c,
           count(*) filter (where l.event_type = 'refund') over (partition by o.subscription_id) as r
    from (select subscription_id, charge_id as trial, date as cohort_date, ip_country, site from led where event_subtype = 'initial_purchase') o
    left join led l on l.subscription_id = o.subscription_id"""
Q["payback_by_site_ranked"] = site_paid(True).replace("site_txn", "repeated_site_txn")

Q["processor_cohort"] = f"""
with ch as (
  select 'sub_' || sub as subscription_id, cast(done_at as date) as date, opening,
         case when k % 5 != 0 and card is not null then card else coalesce(card, 'UNKNOWN') end as ip_country,
         amount / nullif(rate, 0) as charged, case when returned then amount else 0 end / nullif(rate, 0) as given_back, returned
  from (select pay.*, txn.amount, txn.currency, mov.card_address_country as card from pay
        join txn on txn.id = pay.k * 2 join mov on mov.charge_id = 'ch_' || pay.k and mov.event_type = 'charge'
        where kind = 0 and ok = 1 and sub % 7 in (0, 1))
  left join fx on fx.date = cast(done_at as date) and fx.code = currency
  join pcust on pcust.id = 'cus_' || cust and (email not like '%internal%' or email is null))
select o.date as cohort_date, o.ip_country, count(*) as sub_charges, count(*) filter (where c.returned) as sub_refunds,
       {cents('sum(c.charged) - coalesce(sum(c.given_back), 0)')} as real_revenue
from ch o join ch c on c.subscription_id = o.subscription_id where o.opening group by 1, 2"""

# ----------------------------------------------------------------- dashboards
VIEW["day_spend"] = Q["spend_daily"]
VIEW["day_sales"] = Q["sales_revenue_daily"]
VIEW["day_steps"] = Q["funnel_daily"]


def dashboard(paid: str) -> str:
    zero = ["spend", "sales", "ltv", "user_revenue", "amount_refunds", "landing_page_viewers", "upload_document_users", "sign_ups",
            "payment_page_viewers", "real_revenue", "real_revenue_37d", "charges", "refunds", "first_renewals"]
    source = {"spend": "s", "sales": "d", "ltv": "d", "user_revenue": "d", "amount_refunds": "d", "real_revenue": "p",
              "real_revenue_37d": "p", "charges": "p", "refunds": "p", "first_renewals": "p"}
    cells = ", ".join(f"coalesce({source.get(c, 'f')}.{c}, 0) as {c}" for c in zero)
    return f"""
with spine as (select date, ip_country from day_spend union select date, ip_country from day_sales
               union select date, ip_country from day_steps),
paid as (select cohort_date, ip_country, {paid} from opened_txn group by 1, 2)
select m.date, m.ip_country, {cells}, cast(sum(d.sales) over (partition by m.date) as bigint) as grand_total_sales,
       sum(s.spend) over (partition by m.date) as grand_total_spend
from spine m left join day_spend s on s.date = m.date and s.ip_country = m.ip_country
left join day_sales d on d.date = m.date and d.ip_country = m.ip_country
left join day_steps f on f.date = m.date and f.ip_country = m.ip_country
left join paid p on p.cohort_date = m.date and p.ip_country = m.ip_country"""


Q["dashboard_daily"] = dashboard(PAID)
Q["dashboard_daily_repeat"] = dashboard(PAID_REPEAT)


def multisite(repeat: bool) -> str:
    return f"""
with paid as ({site_paid(repeat)}),
sold as (select *, {dated_ltv()} as ltv from site_sales),
spine as (select date, ip_country, site from site_spend_open union select date, ip_country, site from sold
          union select date, ip_country, site from viewers)
select m.date, m.ip_country, m.site, coalesce(s.spend, 0) as spend, coalesce(d.sales, 0) as sales, coalesce(d.ltv, 0) as ltv,
       coalesce(d.user_revenue, 0) as user_revenue, coalesce(d.amount_refunds, 0) as amount_refunds,
       coalesce(v.landing_page_viewers, 0) as landing_page_viewers, coalesce(p.real_revenue, 0) as real_revenue,
       coalesce(p.real_revenue_37d, 0) as real_revenue_37d, coalesce(p.charges, 0) as charges, coalesce(p.refunds, 0) as refunds,
       coalesce(p.first_renewals, 0) as first_renewals
from spine m left join site_spend_open s using (date, ip_country, site) left join sold d using (date, ip_country, site)
left join viewers v using (date, ip_country, site)
left join paid p on p.cohort_date = m.date and p.ip_country = m.ip_country and p.site = m.site
where m.site in ('A', 'B') and m.date <= {AS_OF} - interval 1 day"""


Q["dashboard_multisite"] = multisite(False)
Q["dashboard_multisite_repeat"] = multisite(True)

# ----------------------------------------------------------------- model input
SUBSCRIBER = """s.subscription_status != 'Registered' and cast(s.created_at as date) > date '1995-01-01'
  and s.id not in (25, 26, 27, 28)"""
CORE = """count(*) filter (where transaction_type = 0) - count(*) filter (where transaction_type = 1) as tenure,
       sum(case transaction_type when 0 then t.amount else -t.amount end) as user_revenue,
       min(payment_date) as initial_payment_date, max(payment_date) as latest_payment_date,
       case when s.unsubscribed_date is not null or s.subscription_status = 'Unsuscribed' then 'churned' else 'active' end as status"""
VIEW["fact"] = f"""
    select s.id as subscription_id, {CORE}, price_amount as amount, price_trial as amount_trial,
           max(coalesce(ua.country, c.ip_country)) as ip_country, cast(date_trunc('month', min(payment_date)) as date) as cohort
    from (select * from txn_dup qualify row_number() over (partition by id order by payment_date desc) = 1) t
    join inv on inv.transaction_id = t.id join subs s on s.id = t.subscription_id
    join subprice sp on sp.subscription_id = s.id left join ua on ua.id = t.user_agent_id
    join ext c on c.id = s.customer_id_np
    where t.transaction_status = 1 and {SUBSCRIBER}
    group by s.id, s.unsubscribed_date, s.subscription_status, price_amount, price_trial having tenure > 0"""
WORD = "case when coalesce(utm_term like '%free%', false) then 'free' else 'other' end"
DOMAIN = "lower(split_part(c.email, '@', 2))"
VIEW["seg"] = f"""
    select s.id as subscription_id, {CORE}, price_amount as amount, price_trial as amount_trial,
           coalesce(ua.country, c.ip_country) as ip_country, strftime(min(payment_date), '%Y-%m') as cohort,
           {WORD} as keyword, 'product_' || s.product_id as sub_product, {DOMAIN} as email_domain,
           case when {DOMAIN} in ({texts(k.CONSUMER_MAIL_DOMAINS)}) then 'B2C' else 'B2B' end as user_segment, ua.device
    from subs s join subprice sp on sp.subscription_id = s.id left join good t on t.subscription_id = s.id
    left join ua on ua.id = t.user_agent_id left join utm on utm.id = t.utms_id join ext c on c.id = s.customer_id_np
    where {SUBSCRIBER}
    group by s.id, s.unsubscribed_date, s.subscription_status, s.product_id, price_amount, price_trial, ua.country, c.ip_country,
             {WORD}, c.email, ua.device
    having tenure > 0"""
FACT = """subscription_id, tenure, cast(user_revenue as double) as user_revenue,
       cast(initial_payment_date as date) as initial_payment_date, cast(latest_payment_date as date) as latest_payment_date, status,
       cast(amount as double) as amount, cast(amount_trial as double) as amount_trial, ip_country, cohort"""
Q["subscription_fact"] = f"select {FACT} from fact"
Q["subscription_segments"] = f"select {FACT}, keyword, sub_product, email_domain, user_segment, device from seg"


def prepared(source: str, offset: int) -> str:
    tiers = " ".join(f"when ip_country in ({texts(m)}) then '{t}'" for t, m in k.MARKET_TIERS.items())
    return f"""
    select * replace (tenure - {offset} as tenure), cast(status = 'churned' as bigint) as churned,
           cast(floor((epoch(timestamp '2001-08-01') - epoch(initial_payment_date)) / 86400) as bigint) as account_age_days,
           (2001 * 12 + 8) - (year(initial_payment_date) * 12 + month(initial_payment_date)) as age,
           case {tiers} end as tier
    from {source} where initial_payment_date <= timestamp '2001-08-01' and tenure - {offset} >= 0"""


VIEW["pre"] = f"""
    select * from ({prepared('fact', 0)}) where amount < 100 and tier is not null
    qualify count(*) over (partition by ip_country) >= 50"""
VIEW["preinc"] = f"""
    select * from ({prepared('fact', 1)}) where amount < 100 and tier is not null
    qualify count(*) over (partition by ip_country) >= 50"""
VIEW["segpre"] = prepared("seg", 1)

Q["model_prep"] = f"select {FACT}, churned, account_age_days, age, tier from pre"
Q["segment_descriptives"] = "select user_segment, count(*) as users, avg(churned) as avg_churn_rate from segpre group by 1"
Q["price_descriptives"] = """
select cast(amount as double) as amount, count(*) as users, avg(tenure) as tenure_avg, max(tenure) as tenure_max
from pre group by pre.amount order by users desc, pre.amount limit 3"""
Q["top_countries"] = "select ip_country, count(*) as users from pre group by 1 order by 2 desc, 1 limit 5"
Q["cr_by_price"] = f"""
select cast(amount as double) as amount, count(*) as n, count(*) filter (where account_age_days >= 8) as eligible_r1,
       {cents('count(*) filter (where account_age_days >= 8 and tenure >= 2) / nullif(count(*) filter (where account_age_days >= 8), 0) * 100')}
         as cr_sale_to_r1,
       count(*) filter (where account_age_days >= 37) as eligible_r2,
       {cents('count(*) filter (where account_age_days >= 37 and tenure >= 3) / nullif(count(*) filter (where account_age_days >= 37), 0) * 100')}
         as cr_sale_to_r2
from pre group by pre.amount"""
Q["cr_by_price_increase"] = Q["cr_by_price"].replace("from pre group by pre.amount", "from preinc group by preinc.amount")

# ------------------------------------------------------------------ life table
VIEW["life"] = """
    select g.user_segment, g.t as month, count(*) filter (where s.tenure >= g.t) as n_risk,
           count(*) filter (where s.tenure = g.t and s.churned = 1) as n_event
    from (select user_segment, unnest(range(0, max(tenure) + 1)) as t from segpre group by 1) g
    join segpre s on s.user_segment = g.user_segment group by 1, 2"""
Q["life_table"] = "select * from life"
VIEW["km"] = """
    select *, 1 - n_event / n_risk as p_survival,
           product(1 - n_event / n_risk) over (partition by user_segment order by month) as survival_rate
    from (select g.user_segment, g.t as month, count(*) filter (where s.tenure >= g.t and s.age >= g.t) as n_risk,
                 count(*) filter (where s.tenure = g.t and s.churned = 1) as n_event
          from (select user_segment, unnest(range(0, cast(max(age) as bigint) + 1)) as t from segpre group by 1) g
          join segpre s on s.user_segment = g.user_segment group by 1, 2)
    where n_risk > 0"""
Q["km_survival"] = "select user_segment, month, n_risk, n_event, p_survival, round(survival_rate, 6) as survival_rate from km"
Q["empirical_lifetime"] = "select user_segment, round(sum(survival_rate), 6) as lifetime_months from km group by 1"


# ------------------------------------------------------------------- retention
def days(rule: str) -> str:
    return "case when r = 1 then 8 else 9 + 28 * (r - 1) end" if rule == "first" else "15 + 28 * (r - 1)"


def cells(source: str, keys: str, cycles: int, rule: str) -> str:
    return f"""
    select {keys}{', ' if keys else ''}r, count(*) filter (where account_age_days >= {days(rule)}) as eligible,
           count(*) filter (where account_age_days >= {days(rule)} and tenure >= r + 1) as survivors
    from {source}, (select unnest(range(1, {cycles + 1})) as r) group by all"""


def points(source: str, keys: str, cycles: int, rule: str, at_least: int) -> str:
    part = f"partition by {keys}" if keys else ""
    return f"""
    select *, survivors / eligible as y from ({cells(source, keys, cycles, rule)})
    qualify min(case when eligible < {at_least} then r else 999 end) over ({part}) > r"""


FIVE = texts(k.MODEL_COUNTRIES)
PRICES = ", ".join(str(x) for x in k.PRICE_POINTS)
VIEW["five"] = f"select * from pre where ip_country in ({FIVE}) and amount in ({PRICES})"
VIEW["fiveinc"] = VIEW["five"].replace("from pre ", "from preinc ")


def retention_table(source: str, cycles: int) -> str:
    return f"""
select g.ip_country, cast(g.amount as double) as amount, g.r, coalesce(eligible, 0) as eligible,
       case when eligible >= 20 then survivors / eligible end as retention
from (select ip_country, cast(amount as decimal(10,2)) as amount, r
      from (select unnest([{FIVE}]) as ip_country), (select unnest([{PRICES}]) as amount), (select unnest(range(1, {cycles + 1})) as r)) g
left join ({cells(source, 'ip_country, amount', cycles, 'first')}) c on c.ip_country = g.ip_country and c.amount = g.amount and c.r = g.r"""


Q["retention_table"] = retention_table("five", 3)
Q["retention_table_increase"] = retention_table("fiveinc", 4)
VIEW["five_points"] = points("five", "ip_country, amount", 12, "first", 20)
Q["retention_curve"] = """
select ip_country, cast(amount as double) as amount, r + 1 as cycle, y as retention from five_points
union all select ip_country, cast(amount as double), 1, 1.0 from five_points where r = 1"""
VIEW["fiveinc_points"] = points("fiveinc", "ip_country, amount", 12, "first", 20)
Q["retention_curve_increase"] = Q["retention_curve"].replace("five_points", "fiveinc_points")
Q["min_days"] = f"""
select rule, r, d as min_days, count(*) filter (where account_age_days >= d) as eligible
from pre, (select 'first' as rule, r, {days('first')} as d from (select unnest(range(1, 13)) as r)
           union all select 'second', r, {days('second')} from (select unnest(range(1, 13)) as r)) group by 1, 2, 3"""

# ------------------------------------------------------------------ projection
NEWTON = """
with recursive {pts}, walk as (
  select {key}, case when min(y) > 0 then exp(regr_intercept(ln(greatest(y, 1e-9)), ln(x))) else 0.5 end as a,
         case when min(y) > 0 then regr_slope(ln(greatest(y, 1e-9)), ln(x)) else -0.5 end as b, 0 as i, count(*) as n_points
  from pt group by {key} having count(*) >= {least}
  union all
  select {key}, a + (vv * ug - uv * vg) / (uu * vv - uv * uv), b + (uu * vg - uv * ug) / (uu * vv - uv * uv), i + 1, n_points
  from (select {key}, a, b, i, n_points, sum(u * u) as uu, sum(u * v) as uv, sum(v * v) as vv, sum(u * g) as ug, sum(v * g) as vg
        from (select w.{key}, a, b, i, n_points, x ** b as u, a * x ** b * ln(x) as v, y - a * x ** b as g
              from walk w join pt on pt.{key} = w.{key} where i < 40) group by {key}, a, b, i, n_points)),
fit as (select {key}, a as alpha, b as beta, n_points from walk where i = 40)"""

VIEW["base_pt"] = f"select ip_country, cast(r as double) as x, y from ({points('pre', 'ip_country', 12, 'second', 50)})"
BASE = NEWTON.format(key="ip_country", least=3, pts="pt as (select * from base_pt)")
Q["power_law_loglog"] = """
select ip_country, count(*) as n_points, round(exp(regr_intercept(ln(nullif(y, 0)), ln(x))), 6) as alpha,
       round(regr_slope(ln(nullif(y, 0)), ln(x)), 6) as beta
from base_pt group by 1 having count(*) >= 3"""
Q["power_law_fit"] = f"{BASE} select ip_country, n_points, round(alpha, 6) as alpha, round(beta, 6) as beta from fit"
Q["base_curve"] = f"""{BASE}
select f.ip_country, m as month, round(coalesce(y, alpha * m ** beta), 6) as retention
from (select *, unnest(range(1, 37)) as m from fit) f left join pt on pt.ip_country = f.ip_country and x = m"""


def scenarios(baseline_age: int, volume: int, new_cycles: int, countries: str = "") -> str:
    """Curves of the baseline and of the new prices: (country, price, month, retention, rows, mature)."""
    only = f" and ip_country in ({countries})" if countries else ""
    first = f"""pre0 as (select * from pre where initial_payment_date < timestamp '1998-01-01' and account_age_days >= {baseline_age}{only}),
 pre1 as (select *, amount as price from pre where (amount = 39.95 and initial_payment_date >= timestamp '1998-01-01')
          or (amount = 49.95 and initial_payment_date >= timestamp '1999-01-01')),
 pt as (select ip_country, cast(r as double) as x, y from ({points('pre0', 'ip_country', 12, 'second', 50)})),
 np as (select ip_country, price, r as x, y, eligible from ({points('pre1', 'ip_country, price', new_cycles, 'second', 20)}))"""
    return NEWTON.format(key="ip_country", least=3, pts=first) + f""",
size as (select ip_country, count(*) as rows, count(*) filter (where account_age_days >= 15) as mature from pre0 group by 1
         having count(*) >= {volume}),
base as (select f.ip_country, m as month, coalesce(y, alpha * m ** beta) as s
         from (select *, unnest(range(1, 37)) as m from fit) f join size using (ip_country)
         left join pt on pt.ip_country = f.ip_country and x = m),
chain as (
  select np.ip_country, np.price, m.month, coalesce(o.y, np.y * m.s / nullif(e.s, 0)) as s
  from np join base m on m.ip_country = np.ip_country join base e on e.ip_country = np.ip_country and e.month = np.x
  left join np o on o.ip_country = np.ip_country and o.price = np.price and o.x = m.month
  where np.x = (select max(x) from np z where z.ip_country = np.ip_country and z.price = np.price)),
curves as (
  select ip_country, cast(null as decimal(10,2)) as price, month, s, rows, mature from base join size using (ip_country)
  union all
  select c.ip_country, c.price, c.month, c.s, n.eligible, n.eligible from chain c
  join np n on n.ip_country = c.ip_country and n.price = c.price and n.x = 1)"""


Q["stitched_curve"] = f"""{scenarios(0, 0, 1, FIVE)}
select ip_country, cast(price as double) as price, month, round(s, 6) as retention from curves where price is not null"""
Q["scenario_report"] = f"""{scenarios(180, 100, 2, FIVE)}
select ip_country as country, case when price is null then 'Historico_Antiguo' else 'Precio_' || price end as scenario,
       rows as sample_size, round(sum(s), 6) as lt_36m,
       {', '.join(f'round(sum(s) filter (where month <= {m}), 6) as month_{m}' for m in range(1, 37))}
from curves group by 1, 2, 3"""
Q["ltv_projection_dim"] = f"""{scenarios(0, 0, 1, FIVE)}
select ip_country as country, cast(coalesce(price, 29.95) as double) as price, {cents('sum(s)')} as lt_36m, max(mature) as n
from curves group by 1, 2"""


def price_curves() -> str:
    trial = "select amount, r + 1 as x, y from ({}) union all select unnest([{}]), 1, 1.0"
    pts = f"""five0 as (select * from preinc where ip_country in ({FIVE})),
 old as (select * from five0 where amount = 29.95), new as (select * from five0 where amount in (39.95, 49.95)),
 pt as (select cast(amount as decimal(10,2)) as amount, cast(x as double) as x, y
        from ({trial.format(points('old', 'amount', 12, 'first', 100), '29.95')})),
 np as (select cast(amount as decimal(10,2)) as amount, x, y
        from ({trial.format(points('new', 'amount', 3, 'first', 50), '39.95, 49.95')}))"""
    return NEWTON.format(key="amount", least=2, pts=pts) + """,
base as (select month, alpha * month ** beta as s from (select *, unnest(range(1, 37)) as month from fit)),
chain as (
  select np.amount, m.month, coalesce(o.y, np.y * m.s / e.s) as s
  from np join base m on true join base e on e.month = np.x left join np o on o.amount = np.amount and o.x = m.month
  where np.x = (select max(x) from np z where z.amount = np.amount)),
curves as (select cast(29.95 as decimal(10,2)) as amount, month, s from base union all select amount, month, s from chain)"""


Q["lt_cumulative"] = f"""{price_curves()}
select cast(amount as double) as amount, month, round(s, 6) as retention,
       round(sum(s) over (partition by curves.amount order by month), 6) as lifetime from curves"""
Q["curve_detail"] = f"""{price_curves()}
select month as cycle, {', '.join(
    f"{cents(f'max(s) filter (where amount = {x}) * 100')} as retention_pct_{str(x).replace('.', '_')}, "
    f"cast(round(cast(max(lt) filter (where amount = {x}) as decimal(28,8)), 4) as double) as lt_{str(x).replace('.', '_')}"
    for x in k.PRICE_POINTS)}
from (select *, sum(s) over (partition by amount order by month) as lt from curves) group by 1"""

VIEW["flat"] = """
    select g.user_segment, g.month, last_value(s ignore nulls) over (partition by g.user_segment order by g.month) as s
    from (select user_segment, unnest(range(0, 36)) as month from (select distinct user_segment from life)) g
    left join (select user_segment, month, product(1 - n_event / n_risk) over (partition by user_segment order by month) as s
               from life) c on c.user_segment = g.user_segment and c.month = g.month"""
Q["lt_horizons"] = f"""
select user_segment, users, {', '.join(f"{cents(f'sum(s) filter (where month < {m})')} as lt_{m}" for m in (1, 3, 6, 12, 24, 36))}
from flat join (select user_segment, count(*) as users from segpre group by 1) using (user_segment) group by 1, 2"""
Q["ltv_cumulative"] = """
select user_segment, month + 1 as month, round(39.95 * sum(s) over (partition by user_segment order by month), 6) as ltv
from flat where month < 35"""

# The hazard model's mode by coordinate Newton steps in one row of lists: segments, months of even and of odd number, and a shift of all
# segments against all months, which leaves the likelihood as it is. 0.04 and 2.25 are the walk's and the segments' variances.
def _churn(i: str, m: str) -> str:
    return f"(1 / (1 + exp(-(a[{i}] + b[{m}]))))"


_SEGMENT_STEP = f"""list_transform(range(1, s + 1), lambda i: a[i]
    + (list_sum(list_transform(range(1, t + 1), lambda m: y[i][m] - n[i][m] * {_churn('i', 'm')})) - a[i] / 2.25)
    / (list_sum(list_transform(range(1, t + 1), lambda m: n[i][m] * {_churn('i', 'm')} * (1 - {_churn('i', 'm')}))) + 1 / 2.25))"""


def _month_step(odd: int) -> str:
    return f"""list_transform(range(1, t + 1), lambda m: case when m % 2 = {odd} then b[m]
    + (list_sum(list_transform(range(1, s + 1), lambda i: y[i][m] - n[i][m] * {_churn('i', 'm')}))
       - coalesce((b[m] - b[m - 1]) / 0.04, 0) + coalesce((b[m + 1] - b[m]) / 0.04, 0))
    / (list_sum(list_transform(range(1, s + 1), lambda i: n[i][m] * {_churn('i', 'm')} * (1 - {_churn('i', 'm')})))
       + 25 * (case when m > 1 then 1 else 0 end) + 25 * (case when m < t then 1 else 0 end)) else b[m] end)"""


MODE = f"""with recursive named as (select user_segment, row_number() over (order by user_segment) as i from life where n_risk > 0 group by 1),
hazard_cells as (
    select i, m, coalesce(cast(n_risk as double), 0) as n, coalesce(cast(n_event as double), 0) as y
    from named cross join (select unnest(range(0, (select cast(max(month) as bigint) + 1 from life where n_risk > 0))) as m)
    left join life on life.user_segment = named.user_segment and life.month = m),
hazard_lists as (
    select list(n order by i) as n, list(y order by i) as y, count(*) as s, max(len(n)) as t
    from (select i, list(n order by m) as n, list(y order by m) as y from hazard_cells group by i)),
steps as (
    select 0 as k, list_transform(range(0, s), lambda i: 0.0::double) as a, list_transform(range(0, t), lambda m: -1.0::double) as b from hazard_lists
    union all
    select k + 1, list_transform(a, lambda x: x - list_avg(a)), list_transform(b, lambda x: x + list_avg(a))
    from (select k, a, {_month_step(1)} as b
          from (select k, a, {_month_step(0)} as b, n, y, s, t
                from (select k, {_SEGMENT_STEP} as a, b, n, y, s, t from steps, hazard_lists where k < 400)
          )
    )
),
modelled as (
    select user_segment, m as month, 1 / (1 + exp(-(a[i] + b[m + 1]))) as hazard
    from named, (select * from steps where k = 400), (select unnest(range(0, (select t from hazard_lists))) as m))
"""
Q["segment_hazard"] = MODE + "select user_segment, month, round(hazard, 6) as hazard from modelled"
_FLAT = ", modelled_flat as (" + VIEW["flat"].replace("1 - n_event / n_risk", "1 - hazard").replace("from life) c", "from modelled) c") + ")"
Q["lt_horizons_modelled"] = MODE + _FLAT + Q["lt_horizons"].replace("from flat ", "from modelled_flat ")
Q["ltv_cumulative_modelled"] = MODE + _FLAT + Q["ltv_cumulative"].replace("from flat ", "from modelled_flat ")

# ------------------------------------------------------------------------ traps
Q["src_csv_roundtrip"] = """
select ip_country, status, count(*) as subscriptions, cast(sum(tenure) as bigint) as tenure, cast(sum(user_revenue) as double) as user_revenue
from fact group by 1, 2"""
Q["src_csv_quarantine"] = """
select 'good' as kind, status as what, count(*) as n_rows, cast(sum(tenure) as bigint) as tenure
from fact where subscription_id % 10 <> 0 group by 2
union all
select 'bad', case subscription_id % 20 when 0 then 'user_revenue: lots is no decimal(18,2)' else 'tenure: many is no bigint' end, count(*), null
from fact where subscription_id % 10 = 0 group by 2"""
Q["trap_on_vs_where"] = """
select 'on' as placement, count(*) as n_rows, count(t.id) as n_matched from cust c
left join txn t on t.customer_id = c.id and t.transaction_status = 1 and t.transaction_type = 1
union all
select 'where', count(*), count(t.id) from cust c left join txn t on t.customer_id = c.id
where t.transaction_status = 1 and t.transaction_type = 1"""


def early(sql: str) -> str:
    """The statement as of 1998-01-01."""
    return sql.replace("2001-08-01", "1998-01-01").replace("2001 * 12 + 8", "1998 * 12 + 1")


PUBLISHED = ", ".join(f"('{c}', {p}, {lt})" for c, p, lt in k.PUBLISHED_LIFETIMES)
Q["projection_check"] = Q["ltv_projection_dim"].replace(
    "select ip_country as country, cast(coalesce(price, 29.95) as double) as price,", """, own as (
select ip_country as country, cast(coalesce(price, 29.95) as double) as price,""") + f""")
select own.country, own.price, lt_36m, cast(published as double) as published_lt_36m,
       round(lt_36m - published, 2) as difference
from own left join (values {PUBLISHED}) w(country, price, published) on w.country = own.country and w.price = own.price"""


def _gate(rows: str, keep: str) -> str:
    return f"select count(*) as rows, count(*) filter (where not coalesce({keep}, false)) as lost, 0 as gained from ({rows})"


def _join(rows: str, key: str, partners: str, partner: str) -> str:
    return f"""select count(*) as rows, count(*) filter (where n is null) as lost, coalesce(sum(n - 1) filter (where n > 1), 0) as gained
        from ({rows}) x left join (select {partner} as partner, count(*) as n from ({partners}) group by 1) y on y.partner = x.{key}"""


def _account(*steps: tuple[str, str, str]) -> str:
    return " union all ".join(
        f"select cast({i} as bigint) as number, '{step}' as step, '{kind}' as kind, rows, lost, cast(gained as bigint) as gained from ({sql})"
        for i, (step, kind, sql) in enumerate(steps, 1))


_SINCE = "select * from mov where status = 'succeeded' and date >= date '1995-01-01'"
_REVIEWS = "select * from rev where created_at > timestamp '1998-01-02'"
_MAILED = f"{_REVIEWS} and (email not like '%internal%' or email not like '%test%')"
_AUTHORED = f"select r.*, c.id as customer from ({_MAILED}) r left join cust c on c.email = r.email"
_LATEST = "select * from subs qualify row_number() over (partition by customer_id_np order by created_at desc, id desc) = 1"
Q["ledger_reconcile_account"] = _account(
    ("reported merchants", "gate", _gate("select * from mov", "merchant_id in ('m0', 'm1', 'm2', 'm3', 'm4', 'm5', 'm6')")),
    ("succeeded since the start", "gate", _gate("select * from mov", "status = 'succeeded' and date >= date '1995-01-01'")),
    ("external customers", "inner join", _join(_SINCE, "customer_id", "select * from pcust where email not like '%internal%'", "id")),
    ("purchase events", "left join", _join("select * from led", "charge_id", "select * from acq where charge_id is not null", "charge_id")),
    ("internal transactions", "left join", _join("select * from led", "charge_id", "select * from txn", "id_transaction")),
    ("invoices", "left join", _join("select l.*, t.id as own from led l left join txn t on t.id_transaction = l.charge_id", "own",
                                    "select * from inv", "transaction_id")))
Q["reviews_export_account"] = _account(
    ("after the day", "gate", _gate("select * from rev", "created_at > timestamp '1998-01-02'")),
    ("mail patterns", "gate", _gate(_REVIEWS, "email not like '%internal%' or email not like '%test%'")),
    ("authors", "left join", _join(_MAILED, "email", "select * from cust where email is not null", "email")),
    ("latest subscription", "left join", _join(_AUTHORED, "customer", _LATEST, "customer_id_np")),
    ("plan", "left join", _join(f"select a.*, s.subscription_type_id from ({_AUTHORED}) a left join ({_LATEST}) s on s.customer_id_np = a.customer",
                                "subscription_type_id", "select * from plan", "id")))


def oracle_sql() -> dict[str, str]:
    from kohorte.plans.registry import EARLY_REPORTS
    whole = {name: with_views(sql, VIEW) for name, sql in Q.items()}
    # The same reports, folded from feeds.
    whole |= {name: whole[name.removesuffix("_incremental")] for name in ("dedup_incremental", "life_table_incremental", "km_survival_incremental")
              if name.removesuffix("_incremental") in whole} | {"dedup_incremental": whole["dedup_latest_txn"]}
    return whole | {f"{name}_early": early(whole[name]) for name in EARLY_REPORTS}
