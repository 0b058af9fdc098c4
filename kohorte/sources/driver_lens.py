"""The driver's star-schema tables seen as the logical subscription tables.

Each logical table is a lazy projection of the parquet files, written as SQL expressions. Customers hold up
to five subscriptions (one per order priority); an order is a charge, a returned first line a refund.
Set-valued derivations are written so that one customer with a large share of the orders does
not end up in one task: the first charge of a subscription is found by a rank filter (limited
on the map side) and joined back by order key, and counters are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kohorte.sources.catalog import Tables

# Declared, so that opening a table starts no schema-reading job.
DRIVER_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

NATION_CODES = ["US", "AU", "CA", "BR", "GB", "FR", "ES", "DE", "IT"]
CURRENCIES = ["EUR", "USD", "GBP", "CAD", "AUD"]
PRICES = ["29.95", "39.95", "49.95"]
FILE_FORMATS = ["pdf", "PDF", "docx", "DOCX", "csv", "CSV", "jpg", "JPEG", "png", "ppt", "xlsx", "XLS"]


def pick(index: str, values: list[str | None]) -> str:
    """The value at ``index`` (from 0) of a constant list."""
    arms = " ".join(f"when {i} then " + (f"'{v}'" if v is not None else "null") for i, v in enumerate(values))
    return f"case {index} {arms} end"


def nation_code(key: str) -> str:
    return f"coalesce({pick(key, NATION_CODES)}, concat('X', {key}))"


def plan_price(subscription: str) -> str:
    return f"cast({pick(f'{subscription} % 3', PRICES)} as decimal(10,2))"


def card_country(customer: str) -> str:
    return (f"case when {customer} % 17 = 0 then null when {customer} % 25 = 4 then 'UK' "
            f"else {nation_code(f'({customer} % 25)')} end")


def lens(spark: SparkSession, folder: str) -> Tables:
    opened: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
        return opened[name]

    def orders() -> DataFrame:
        return raw("orders").selectExpr(
            "o_orderkey", "o_custkey", "o_orderdate",
            "o_custkey * 5 + cast(left(o_orderpriority, 1) as int) - 1 as subscription_id",
            "case when o_orderstatus = 'P' then 0 else 1 end as status")

    def payments() -> DataFrame:
        """One row per charge and per refund, with the order's keys."""
        base = orders()
        first = base.selectExpr(
            "o_orderkey", "subscription_id",
            "row_number() over (partition by subscription_id, status order by o_orderdate, o_orderkey) as seq",
        ).where("seq <= 2").where("seq = 1 or subscription_id % 13 = 4").selectExpr("o_orderkey", "true as first")
        returned = raw("lineitem").where("l_returnflag = 'R' and l_linenumber = 1").selectExpr(
            "l_orderkey as o_orderkey", "l_shipdate").groupBy("o_orderkey").agg({"l_shipdate": "max"})
        return base.join(first, "o_orderkey", "left").join(returned, "o_orderkey", "left").selectExpr(
            "*", "coalesce(first, false) and status = 1 as opening",
            "`max(l_shipdate)` is not null and status = 1 as refunded",
            "explode(case when `max(l_shipdate)` is not null and status = 1 then array(0, 1) else array(0) end) as kind",
        ).selectExpr(
            "o_orderkey as k", "o_custkey as customer_id", "subscription_id", "status", "opening", "refunded", "kind",
            "case kind when 0 then o_orderdate else greatest(o_orderdate, `max(l_shipdate)`) end as created_at",
            f"case when opening then cast('0.95' as decimal(10,2)) else {plan_price('subscription_id')} end as amount",
            f"{pick('subscription_id % 5', CURRENCIES)} as currency",
            "case k % 3 when 0 then 'card' when 1 then 'wallet' end as apm_type")

    def transactions() -> DataFrame:
        return payments().selectExpr(
            "k * 2 + kind as id", "concat(case kind when 0 then 'ch_' else 're_' end, k) as id_transaction", "customer_id",
            "subscription_id", "customer_id as user_agent_id", "k % 4 as utms_id", "k % 3 as mid_id",
            "kind as transaction_type", "status as transaction_status", "amount", "currency", "apm_type", "created_at",
            "created_at as payment_date")

    def transactions_dup() -> DataFrame:
        columns = [c for c in transactions().columns if c != "payment_date"]
        return transactions().selectExpr("*", "explode(case when id % 10 = 0 then array(0, 1) else array(0) end) as copy").selectExpr(
            *columns, "payment_date - make_dt_interval(copy) as payment_date")

    def invoices() -> DataFrame:
        return raw("lineitem").select("l_orderkey").distinct().selectExpr(
            "explode(array(l_orderkey * 2, l_orderkey * 2 + 1)) as transaction_id").selectExpr(
            "transaction_id", "concat('INV-', transaction_id) as invoice_number")

    def prices() -> DataFrame:
        return spark.range(0, 15, 1, 1).selectExpr(
            "id", f"{plan_price('id')} as amount", f"cast({pick('id % 1', ['0.95'])} as decimal(10,2)) as amount_trial",
            f"{pick('id % 5', CURRENCIES)} as currency")

    def subscription_types() -> DataFrame:
        return spark.range(0, 15, 1, 1).selectExpr("id", "id as price_id", "concat('plan_', id) as name")

    def subscriptions() -> DataFrame:
        per_sub = orders().selectExpr(
            "subscription_id as id", "o_custkey as customer_id_np", "o_orderdate",
            "case when status = 1 then o_orderdate end as success",
        ).groupBy("id", "customer_id_np").agg({"o_orderdate": "min", "success": "max"})
        return per_sub.selectExpr(
            "id", "customer_id_np", "id % 4 as product_id", "id % 15 as subscription_type_id",
            "case when `max(success)` is null then 'Registered' when id % 10 < 4 then 'Unsuscribed' else 'Active' end "
            "as subscription_status",
            "`min(o_orderdate)` as created_at",
            "case when id % 10 < 4 then `max(success)` + interval 20 days end as requested_unsubscribed_date",
            "case when id % 10 < 3 then `max(success)` + interval 30 days end as unsubscribed_date")

    def products() -> DataFrame:
        return spark.range(0, 4, 1, 1).selectExpr("id", "concat('product_', id) as sub_product")

    def utms() -> DataFrame:
        terms = pick("id", ["pdf free", "editor GRATIS", "gratuit pdf"])
        return spark.range(0, 4, 1, 1).selectExpr("id", f"{terms} as utm_term")

    def mids() -> DataFrame:
        return spark.range(0, 3, 1, 1).selectExpr("id", "concat('mid_', id) as internal_mid_name")

    def customers() -> DataFrame:
        return raw("customer").selectExpr(
            "c_custkey as id",
            """case when c_custkey % 50 = 3 then null
                    when c_custkey % 20 = 7 then concat('qa', c_custkey, '@internal.test')
                    when c_custkey % 4 = 0 then concat('u', c_custkey, '@gmail.com')
                    else concat('u', c_custkey, '@firm', c_nationkey, '.com') end as email""",
            f"case when c_custkey % 25 <> 11 then {nation_code('c_nationkey')} end as ip_country",
            "timestamp_ntz'1995-01-01' + make_dt_interval(cast(c_custkey % 2000 as int)) as created_at")

    def user_agents() -> DataFrame:
        return raw("customer").selectExpr(
            "c_custkey as id", "case c_custkey % 3 when 0 then 'Desktop' when 1 then 'Mobile' end as device",
            f"{nation_code('((c_nationkey + 1) % 25)')} as ip_country_iso_code")

    def marketing_spends() -> DataFrame:
        supplier = raw("supplier").selectExpr(
            "s_suppkey as l_suppkey", f"case s_nationkey when 4 then 'UK' else {nation_code('s_nationkey')} end as geo")
        per_supplier = raw("lineitem").selectExpr(
            "cast(l_shipdate as date) as date", "l_suppkey", "cast(l_quantity as decimal(18,2)) as costs",
        ).groupBy("date", "l_suppkey").agg({"costs": "sum"})
        return per_supplier.join(supplier, "l_suppkey").selectExpr(
            "date", "geo", "case when l_suppkey % 2 = 0 then 'web' else 'pdf' end as project_id", "`sum(costs)` as costs",
        ).groupBy("date", "geo", "project_id").agg({"costs": "sum"}).selectExpr(
            "date", "geo", "cast(`sum(costs)` as decimal(18,2)) as costs", "project_id")

    def spends_of(project: str) -> DataFrame:
        return marketing_spends().where(f"project_id = '{project}'")

    def exchange_rates() -> DataFrame:
        codes = ", ".join(f"'{c}'" for c in CURRENCIES)
        return raw("orders").selectExpr("cast(o_orderdate as date) as date").distinct().selectExpr(
            "date", f"posexplode(array({codes})) as (i, code)").selectExpr(
            "date", "code", "cast(1 + i * 0.10 + dayofmonth(date) * 0.01 as decimal(10,4)) as rate")

    def countries() -> DataFrame:
        return raw("nation").selectExpr(
            "n_name as country_name",
            f"explode(case n_nationkey when 4 then array('GB', 'UK') else array({nation_code('n_nationkey')}) end) "
            "as country_iso_2")

    def events() -> DataFrame:
        home = raw("customer").selectExpr("c_custkey as user_id", "c_nationkey as n_nationkey")
        nation = raw("nation").select("n_nationkey", "n_name")
        return raw("events").join(home, "user_id").join(nation, "n_nationkey").selectExpr(
            "ts - interval 8766 days as event_time",
            """case when event_id % 3 = 2 and event_type = 'view' then 'view_page' when event_type = 'view' then 'landing_page_viewed'
                    when event_type = 'click' then 'upload_document' when event_type = 'signup' then 'sign_up'
                    when event_type = 'purchase' then 'payment_page_viewed'
                    when event_type = 'error' then 'initial_purchase_event' end as event_type""",
            "user_id as amplitude_id", "concat(' ', n_name) as country",
            f"{pick('event_id % 3', ['editor', 'web', 'mobile'])} as project_id",
            "case when event_id % 10 = 9 then 'dev' else 'prod' end as environment",
            """concat('{"charge_id": "ch_', get_json_object(props, '$.k'), '", "page_name": "',
                      case when event_id % 2 = 0 then 'tool_page' else 'home' end, '"}') as event_properties""")

    def money_movements() -> DataFrame:
        return payments().selectExpr(
            "cast(created_at as date) as event_date", "case kind when 1 then 'refund' else 'charge' end as event_type",
            "case when kind = 1 then 'refund' when opening then 'initial_purchase' else 'renewal' end as event_subtype",
            "concat('ch_', k) as charge_id", "concat('cus_', customer_id) as customer_id",
            "concat('sub_', subscription_id) as subscription_id",
            "cast(case when opening then 0 else 1 + k % 12 end as int) as recurrence_cycle",
            "cast(case kind when 1 then -amount else amount end as decimal(18,2)) as gross_amount",
            "apm_type as payment_method_type", "case when k % 2 = 0 then 'debit' else 'credit' end as card_funding",
            f"{card_country('customer_id')} as card_address_country", "concat('m', subscription_id % 7) as merchant_id",
            "case status when 1 then 'succeeded' else 'failed' end as status")

    def processor_charges() -> DataFrame:
        return payments().where("kind = 0").selectExpr(
            "concat('ch_', k) as id", "created_at as captured_at",
            "case when opening then 'Subscription creation' else 'Subscription update' end as description",
            "cast(amount * 100 as bigint) as amount",
            "cast(case when refunded then amount * 100 else 0 end as bigint) as amount_refunded", "lower(currency) as currency",
            f"case when k % 5 <> 0 then {card_country('customer_id')} end as card_country",
            f"{card_country('customer_id')} as card_address_country", "concat('cus_', customer_id) as customer_id",
            "concat('m', subscription_id % 7) as merchant_id",
            "case status when 1 then 'succeeded' else 'failed' end as status")

    def processor_refunds() -> DataFrame:
        return payments().where("kind = 1").selectExpr(
            "concat('re_', k) as id", "concat('ch_', k) as charge_id", "cast(amount * 100 as bigint) as amount",
            "concat('m', subscription_id % 7) as merchant_id", "'succeeded' as status")

    def processor_invoices() -> DataFrame:
        return orders().selectExpr("concat('ch_', o_orderkey) as charge_id", "concat('sub_', subscription_id) as subscription_id")

    def processor_customers() -> DataFrame:
        return customers().selectExpr("concat('cus_', id) as id", "email")

    def files() -> DataFrame:
        return raw("part").selectExpr(
            "p_partkey as id", f"{pick('p_partkey % 12', FILE_FORMATS)} as file_format",
            """case p_partkey % 3 when 0 then concat(p_size, 'MB') when 1 then concat(p_size * 10, 'KB')
                    else concat(p_size, 'mb') end as file_size""",
            "timestamp_ntz'1995-01-01' + make_dt_interval(cast(p_partkey % 2000 as int)) as created_at")

    def reviews() -> DataFrame:
        how_many = raw("customer").groupBy().count().scalar()
        author = customers().selectExpr("id as author", "email")
        return raw("documents").withColumn("author", raw("documents")["doc_id"] % how_many).join(author, "author", "left").selectExpr(
            "doc_id as id", "email", "cast(1 + doc_id % 5 as int) as rating", "text as comment",
            "timestamp_ntz'1998-01-01' + make_dt_interval(cast(doc_id % 900 as int)) as created_at")

    def ltv_windows() -> DataFrame:
        """A value for three quarters of a year out of four and each country, with gaps, open at both ends."""
        quarters = raw("orders").selectExpr("cast(date_trunc('quarter', o_orderdate) as date) as q").distinct()
        return quarters.selectExpr("q", "explode(sequence(0, 24)) as n").where("(n + quarter(q)) % 4 <> 0").selectExpr(
            f"{nation_code('n')} as country", "case when q > date'1995-03-31' then q end as valid_from",
            "case when q < date'2001-07-01' then date_sub(add_months(q, 3), 1 + n % 5) end as valid_to",
            "cast(40 + n + (year(q) - 1995) * 4 + quarter(q) as decimal(10,2)) as value")

    return Tables({
        "customers": customers,
        "transactions": transactions,
        "transactions_dup": transactions_dup,
        "subscriptions": subscriptions,
        "subscription_types": subscription_types,
        "prices": prices,
        "products": products,
        "invoices_sii": invoices,
        "http_user_agents": user_agents,
        "utms": utms,
        "mids": mids,
        "reviews": reviews,
        "files": files,
        "countries": countries,
        "marketing_spends": marketing_spends,
        "marketing_spends_pdf": lambda: spends_of("pdf"),
        "marketing_spends_web": lambda: spends_of("web"),
        "eur_exchange_rates": exchange_rates,
        "ltv_windows": ltv_windows,
        "events": events,
        "money_movements": money_movements,
        "processor_charges": processor_charges,
        "processor_refunds": processor_refunds,
        "processor_invoices": processor_invoices,
        "processor_customers": processor_customers,
    })
