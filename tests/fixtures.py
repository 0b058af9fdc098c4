"""Small hand-made logical tables."""

from datetime import date, datetime
from decimal import Decimal

from kohorte.params import Params
from kohorte.sources.catalog import Tables
from kohorte.sources.schemas import SCHEMAS

P = Params(as_of=date(2000, 12, 31), start=date(2000, 1, 1), merchant_sites={"m0": "A", "m2": "B"}, report_sites=("A", "B"),
           price_dates={Decimal("39.95"): date(2000, 3, 1), Decimal("49.95"): date(2000, 6, 1)})


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def charge(key, sub, amount, when, *, customer=1, kind=0, status=1, currency="EUR", agent=None, term=None):
    return (key, f"ch_{key}", customer, sub, agent, term, None, kind, status, Decimal(amount), currency, None, at(when), at(when))


def table(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


DEFAULTS = {
    "customers": [(1, "a@gmail.com", "US", at("2000-01-01")), (2, "qa@internal.test", "US", at("2000-01-01")),
                  (3, None, "FR", at("2000-01-01")), (4, "b@firm.com", None, at("2000-01-01"))],
    "subscriptions": [(i, 1, 0, 1, "Active", at("2000-02-01"), None, None) for i in range(1, 9)],
    "subscription_types": [(1, 1, "plan")],
    "prices": [(1, Decimal("29.95"), Decimal("0.95"), "EUR")],
    "products": [(0, "product")],
    "utms": [(1, "pdf FREE"), (2, None)],
    "mids": [(1, "mid")],
    "http_user_agents": [(1, None, "GB"), (2, "Mobile", None)],
}


def tables(spark, transactions, **given) -> Tables:
    rows = {**DEFAULTS, **given, "transactions": transactions}
    rows.setdefault("invoices_sii", [(t[0], f"INV-{t[0]}") for t in transactions])
    rows.setdefault("eur_exchange_rates", [
        (d, "EUR", Decimal("1.0000")) for d in sorted({t[12].date() for t in transactions})])
    return Tables({n: (lambda n=n: table(spark, n, rows[n])) for n in rows})
