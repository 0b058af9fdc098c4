"""Fixed business values that results depend on."""

from decimal import Decimal

# Static conversion rates to EUR, used by the price-based payback reports.
STATIC_FX = {
    "EUR": Decimal("1.0"),
    "AUD": Decimal("0.61124"),
    "USD": Decimal("0.85614"),
    "CAD": Decimal("0.628425"),
    "GBP": Decimal("1.157"),
}
STATIC_FX_DEFAULT = Decimal("1.0")

# Lifetime value per country, and the value of every other country.
COUNTRY_LTV = {
    "AU": Decimal("98.88"),
    "ES": Decimal("101.60"),
    "DE": Decimal("115.02"),
    "CA": Decimal("86.52"),
    "MX": Decimal("97.45"),
    "US": Decimal("101.60"),
    "IT": Decimal("88.83"),
    "GB": Decimal("86.98"),
    "FR": Decimal("77.02"),
    "NL": Decimal("76.70"),
    "BR": Decimal("64.88"),
    "PL": Decimal("108.31"),
    "SA": Decimal("89.47"),
    "PH": Decimal("45.72"),
    "IN": Decimal("19.22"),
}
COUNTRY_LTV_DEFAULT = Decimal("101.60")

# Dated lifetime values (country, first day, last day, value); None is open.
# The days between two windows of a country take the default.
DATED_LTV = [
    ("US", "2025-10-01", "2025-11-30", Decimal("82.78")),
    ("US", "2026-01-08", "2026-03-24", Decimal("100.90")),
    ("US", "2026-03-27", None, Decimal("85.94")),
    ("GB", "2025-10-01", "2025-11-30", Decimal("80.47")),
    ("GB", "2026-01-08", "2026-03-24", Decimal("89.82")),
    ("GB", "2026-03-27", None, Decimal("63.70")),
    ("FR", "2026-01-08", "2026-03-24", Decimal("68.33")),
    ("FR", "2026-03-27", None, Decimal("124.33")),
    ("CA", "2026-01-08", "2026-03-24", Decimal("84.65")),
    ("CA", "2026-03-27", None, Decimal("82.55")),
    ("AU", "2026-01-08", "2026-03-24", Decimal("90.06")),
    ("AU", "2026-03-27", None, Decimal("74.43")),
    ("ES", None, None, Decimal("101.60")),
    ("DE", None, None, Decimal("115.02")),
    ("MX", None, None, Decimal("97.45")),
    ("IT", None, None, Decimal("88.83")),
    ("NL", None, None, Decimal("76.70")),
    ("BR", None, None, Decimal("64.88")),
    ("PL", None, None, Decimal("108.31")),
    ("SA", None, None, Decimal("89.47")),
    ("PH", None, None, Decimal("45.72")),
    ("IN", None, None, Decimal("19.22")),
]
DATED_LTV_DEFAULT = Decimal("92.24")

# Published 36-month lifetimes (country, price, months).
PUBLISHED_LIFETIMES = [
    ("US", Decimal("29.95"), Decimal("3.57")),
    ("US", Decimal("39.95"), Decimal("3.46")),
    ("US", Decimal("49.95"), Decimal("2.92")),
    ("AU", Decimal("29.95"), Decimal("4.33")),
    ("AU", Decimal("39.95"), Decimal("3.94")),
    ("AU", Decimal("49.95"), Decimal("3.37")),
    ("FR", Decimal("29.95"), Decimal("3.00")),
    ("FR", Decimal("39.95"), Decimal("3.23")),
    ("FR", Decimal("49.95"), Decimal("3.45")),
    ("GB", Decimal("29.95"), Decimal("2.57")),
    ("GB", Decimal("39.95"), Decimal("2.64")),
    ("GB", Decimal("49.95"), Decimal("2.05")),
    ("CA", Decimal("29.95"), Decimal("3.74")),
    ("CA", Decimal("39.95"), Decimal("3.54")),
    ("CA", Decimal("49.95"), Decimal("3.59")),
]

# Mailbox providers whose users count as private customers.
CONSUMER_MAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "ymail.com", "myyahoo.com", "hotmail.com", "hotmail.es",
    "outlook.com", "outlook.com.au", "live.com", "icloud.com", "me.com", "mac.com",
    "aol.com", "msn.com", "protonmail.com", "proton.me", "mail.com", "gmx.com",
    "mailfence.com", "fastmail.com", "comcast.net", "verizon.net", "att.net",
    "bellsouth.net", "sbcglobal.net", "earthlink.net", "frontier.com", "cox.net",
    "charter.net", "windstream.net", "netzero.net", "pacbell.net", "prodigy.net",
    "126.com", "mail.ru", "hushmail.com",
]

# Words that mark a search term as looking for something free.
FREE_WORDS = ["free", "gratis", "gratuit"]

# Upload formats and the group each spelling belongs to.
FILE_FORMAT_GROUPS = {
    "DOC": "doc", "doc": "doc", "docx": "doc",
    "CSV": "csv",
    "jpeg": "jpg", "JPEG": "jpg", "jpg": "jpg", "JPG": "jpg",
    "pdf": "pdf", "Pdf": "pdf", "PDF": "pdf",
    "png": "png", "PNG": "png",
    "ppt": "ppt", "PPT": "ppt", "pptx": "ppt", "PPTX": "ppt",
    "xls": "excel", "xlsx": "excel",
}
FILE_FORMAT_OTHER = "others"

# Market tiers and their countries.
MARKET_TIERS = {
    "T1_CORE_ENG": ["US", "CA", "GB", "AU", "NZ"],
    "T2_WEST_EU": ["DE", "FR", "NL", "BE", "AT", "CH", "DK", "SE", "NO", "PL"],
    "T3_MED_LATAM_PREM": ["ES", "IT", "MX", "CL", "BR"],
    "T4_EMERGING": ["CO", "AR", "PE", "EC", "UY", "VE", "TR", "IN", "PH"],
    "T5_SPECIAL": ["JP", "KR", "SG", "SA"],
}

# Countries reported by the payback and by the lifetime models.
PAYBACK_COUNTRIES = ["US", "AU", "CA", "BR", "GB", "FR", "ES", "DE", "IT"]
MODEL_COUNTRIES = ["US", "AU", "FR", "GB", "CA"]

# Price points of the recurring charge, oldest first.
PRICE_POINTS = [Decimal("29.95"), Decimal("39.95"), Decimal("49.95")]

# Events that mark the steps of the funnel, in their order.
FUNNEL_EVENTS = {
    "landing_page_viewers": "landing_page_viewed",
    "upload_document_users": "upload_document",
    "sign_ups": "sign_up",
    "payment_page_viewers": "payment_page_viewed",
}

# Events of page views.
PAGE_EVENTS = ["view_page", "begin_checkout", "click", "view"]

# Subscription statuses (as they are spelled).
REGISTERED = "Registered"
UNSUBSCRIBED = "Unsuscribed"

# Ledger words.
OPENING_SUBTYPE = "initial_purchase"

# Names of the scenarios of the projection report.
BASELINE_SCENARIO = "Historico_Antiguo"
PRICE_SCENARIO = "Precio_"

# Account ages in days at which a sale counts for the first and second renewal rate.
FIRST_RENEWAL_DAYS = 8
SECOND_RENEWAL_DAYS = 37

# Trial days, days of a cycle, and days of grace of the two maturity rules.
TRIAL_DAYS = 7
CYCLE_DAYS = 28
FIRST_RULE_GRACE = 2
SECOND_RULE_GRACE = 8
