"""Explicit schemas of the logical tables."""

from pyspark.sql.types import StructType

SCHEMAS = {
    "customers": "id bigint, email string, ip_country string, created_at timestamp",
    "transactions": (
        "id bigint, id_transaction string, customer_id bigint, subscription_id bigint, user_agent_id bigint, "
        "utms_id bigint, mid_id bigint, transaction_type int, transaction_status int, amount decimal(10,2), "
        "currency string, apm_type string, created_at timestamp, payment_date timestamp"
    ),
    "subscriptions": (
        "id bigint, customer_id_np bigint, product_id bigint, subscription_type_id bigint, subscription_status string, "
        "created_at timestamp, requested_unsubscribed_date timestamp, unsubscribed_date timestamp"
    ),
    "subscription_types": "id bigint, price_id bigint, name string",
    "prices": "id bigint, amount decimal(10,2), amount_trial decimal(10,2), currency string",
    "products": "id bigint, sub_product string",
    "invoices_sii": "transaction_id bigint, invoice_number string",
    "http_user_agents": "id bigint, device string, ip_country_iso_code string",
    "utms": "id bigint, utm_term string",
    "mids": "id bigint, internal_mid_name string",
    "reviews": "email string, rating int, comment string, created_at timestamp",
    "files": "id bigint, file_format string, file_size string, created_at timestamp",
    "countries": "country_name string, country_iso_2 string",
    "marketing_spends": "date date, geo string, costs decimal(18,2), project_id string",
    "eur_exchange_rates": "date date, code string, rate decimal(10,4)",
    "events": (
        "event_time timestamp, event_type string, amplitude_id bigint, country string, project_id string, "
        "environment string, event_properties string"
    ),
    "money_movements": (
        "event_date date, event_type string, event_subtype string, charge_id string, customer_id string, "
        "subscription_id string, recurrence_cycle int, gross_amount decimal(18,2), payment_method_type string, "
        "card_funding string, card_address_country string, merchant_id string, status string"
    ),
    "processor_charges": (
        "id string, captured_at timestamp, description string, amount bigint, amount_refunded bigint, currency string, "
        "card_country string, card_address_country string, customer_id string, merchant_id string, status string"
    ),
    "processor_refunds": "id string, charge_id string, amount bigint, merchant_id string, status string",
    "processor_invoices": "charge_id string, subscription_id string",
    "processor_customers": "id string, email string",
    "ltv_windows": "country string, valid_from date, valid_to date, value decimal(10,2)",
    "subscription_fact": (
        "subscription_id bigint, tenure bigint, user_revenue decimal(18,2), initial_payment_date timestamp, cohort date, "
        "latest_payment_date timestamp, status string, amount decimal(10,2), amount_trial decimal(10,2), ip_country string"
    ),
}


def schema_of(table: str) -> StructType:
    """The schema as a ``StructType`` (needs a running session)."""
    return StructType.fromDDL(SCHEMAS[table])
