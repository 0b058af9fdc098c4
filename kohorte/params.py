"""Business parameters. Nothing about dates, thresholds, sites or markets is baked into an operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from decimal import Decimal

from kohorte.functions import constants as k


@dataclass(frozen=True)
class Params:
    as_of: date
    start: date
    internal_mail: str = "%internal%"
    second_mail_pattern: str = "%test%"
    trial_below: Decimal = Decimal("5")
    wide_trial_below: Decimal = Decimal("10")
    renewal_above: Decimal = Decimal("5")
    payback_countries: Sequence[str] = tuple(k.PAYBACK_COUNTRIES)
    ratio_min_age_days: int = 45
    ratio_more_than: int = 50
    payback_days: int = 37
    payback_charges: int = 3
    test_subscriptions: Sequence[int] = ()
    default_device: str = "Desktop"
    # ledger
    merchant_sites: Mapping[str, str] = field(default_factory=dict)
    no_site: str = "NULL"
    report_sites: Sequence[str] = ()
    local_zone: str = "Europe/Madrid"
    processor_merchants: Sequence[str] = ()
    creation_text: str = "Subscription creation"
    # product events
    environment: str = "prod"
    funnel_projects: Sequence[str] = ()
    acquisition_projects: Sequence[str] = ()
    purchase_event: str = "initial_purchase_event"
    charge_key: str = "charge_id"
    # models
    annual_from: Decimal = Decimal("100")
    min_country_volume: int = 50
    model_countries: Sequence[str] = tuple(k.MODEL_COUNTRIES)
    price_points: Sequence[Decimal] = tuple(k.PRICE_POINTS)
    price_dates: Mapping[Decimal, date] = field(default_factory=dict)
    horizon: int = 36
    max_cycles: int = 12
    min_eligible: int = 20
    min_curve_points: int = 3
    min_curve_users: int = 50
    arpu: Decimal = Decimal("39.95")

    @property
    def yesterday(self) -> date:
        return self.as_of - timedelta(days=1)

    def days_ago(self, n: int) -> date:
        return self.as_of - timedelta(days=n)
