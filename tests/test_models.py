from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import P
from kohorte.operators import hazard, projection, retention


def fact_rows(spark, people):
    """(country, price, tenure, age in days, status) per subscription."""
    end = datetime(2000, 12, 31)
    data = [(i, t, Decimal("1.00"), end - timedelta(days=a), s, Decimal(price), c, "B2C" if i % 2 else "B2B")
            for i, (c, price, t, a, s) in enumerate(people)]
    return spark.createDataFrame(
        data, "subscription_id bigint, tenure bigint, user_revenue decimal(18,2), initial_payment_date timestamp, status string, "
              "amount decimal(10,2), ip_country string, user_segment string")


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(5)
    return [(str(rng.choice(["US", "FR", "JP", "X9"])), str(rng.choice(["29.95", "39.95", "120.00"])), int(rng.integers(0, 7)),
             int(rng.integers(0, 300)), str(rng.choice(["churned", "active"]))) for _ in range(400)]


def test_model_prep_gates(spark, people):
    got = retention.model_prep(fact_rows(spark, people), P, tenure_offset=1)
    kept = [x for x in people if x[1] != "120.00" and x[2] >= 1 and x[0] != "X9"]
    n = {c: sum(x[0] == c for x in kept) for c in ("US", "FR", "JP")}
    assert {r[0]: r[1] for r in got.groupBy("ip_country").count().collect()} == {c: m for c, m in n.items() if m >= 50}
    assert got.agg(F.min("tenure")).first()[0] == 0


def test_cells_give_the_same_answers_as_rows(spark, people):
    rows = retention.model_rows(fact_rows(spark, people), P)
    cells = retention.fold(rows, "ip_country", "tier", "amount", "user_segment")
    for make in (retention.cr_by_price, retention.price_descriptives, retention.top_countries, retention.life_table,
                 retention.km_survival, retention.segment_descriptives, lambda d: retention.retention_table(d, P),
                 lambda d: retention.retention_curve(d, P), lambda d: retention.volume_gate(d, P).groupBy("tier").agg(
                     F.max("tenure"))):
        a, b = (sorted(map(repr, make(x).collect())) for x in (rows, cells))
        assert a == b


def test_life_table_and_survival_against_loops(spark, people):
    rows = retention.model_rows(fact_rows(spark, people), P, markets=False, annual=True)
    data = [(r["user_segment"], r["tenure"], r["age"], r["churned"]) for r in rows.collect()]
    life = {(r[0], r[1]): (r[2], r[3]) for r in retention.life_table(rows).collect()}
    km = {(r["user_segment"], r["month"]): r for r in retention.km_survival(rows).collect()}
    for segment in ("B2B", "B2C"):
        mine = [x[1:] for x in data if x[0] == segment]
        for t in range(max(x[0] for x in mine) + 1):
            assert life[segment, t] == (sum(x[0] >= t for x in mine), sum(x[0] == t and x[2] == 1 for x in mine))
        product = 1.0
        for t in range(max(x[1] for x in mine) + 1):
            risk = sum(x[0] >= t and x[1] >= t for x in mine)
            events = sum(x[0] == t and x[2] == 1 for x in mine)
            if risk:
                product *= 1 - events / risk
                assert (km[segment, t]["n_risk"], km[segment, t]["n_event"]) == (risk, events)
                assert km[segment, t]["survival_rate"] == pytest.approx(product, abs=1e-12)
            else:
                assert (segment, t) not in km


def test_survival_stays_zero_after_everyone_left(spark):
    table = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 1.0), ("a", 2, 0.1)], "user_segment string, month bigint, hazard double")
    got = projection.survival_to(table, 5).orderBy("month").collect()
    assert [r["survival"] for r in got] == [0.5, 0.0, 0.0, 0.0, 0.0]


def test_curve_stops_at_the_first_thin_cycle(spark):
    counts = [(30, 400), (30, 60), (5, 40), (30, 20)]
    people = [("US", "29.95", 9, age, "active") for n, age in counts for _ in range(n)]
    rows = retention.model_rows(fact_rows(spark, people), P)
    got = retention.retention_curve(rows, P, at_least=50).orderBy("cycle").collect()
    # old enough for r1 (8 d): 95, r2 (37 d): 65, r3 (65 d): 30 -> thin, not resumed
    assert [(r["cycle"], r["retention"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_grid_is_complete(spark, people):
    rows = retention.model_rows(fact_rows(spark, people), P)
    got = retention.retention_table(rows, P).collect()
    assert len(got) == 5 * 3 * 3
    assert all(r["retention"] is None for r in got if r["eligible"] < 20)


def curve(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_power_law_is_recovered(spark):
    rows = [(g, m, a * m ** b) for g, a, b in (("u", 0.62, -0.45), ("v", 0.9, -1.7)) for m in range(1, 9)]
    points = curve(spark, rows, "g string, x bigint, y double")
    for fit in (projection.power_law_fit, projection.power_law_loglog):
        got = {r["g"]: (r["alpha"], r["beta"]) for r in fit(points, ["g"]).collect()}
        assert got["u"] == pytest.approx((0.62, -0.45), abs=1e-6)
        assert got["v"] == pytest.approx((0.9, -1.7), abs=1e-6)


def test_power_law_fit_is_the_least_squares_minimum_even_with_zeros(spark):
    y = [0.61, 0.35, 0.30, 0.18, 0.17, 0.0, 0.09]
    points = curve(spark, [("g", m + 1, v) for m, v in enumerate(y)], "g string, x bigint, y double")
    fit = projection.power_law_fit(points, ["g"]).first()
    x = np.arange(1, len(y) + 1)

    def loss(a, b):
        return float(np.sum((np.array(y) - a * x ** b) ** 2))

    best = loss(fit["alpha"], fit["beta"])
    for da, db in ((1e-4, 0), (-1e-4, 0), (0, 1e-4), (0, -1e-4), (1e-4, 1e-4), (-1e-4, -1e-4)):
        assert loss(fit["alpha"] + da, fit["beta"] + db) >= best


def test_too_few_points_have_no_fit(spark):
    points = curve(spark, [("g", 1, 0.5), ("g", 2, 0.4)], "g string, x bigint, y double")
    assert projection.power_law_fit(points, ["g"]).count() == 0


def test_stitching_equals_the_chained_rates(spark):
    base_values = [0.6, 0.4, 0.3]
    base = curve(spark, [("US", m + 1, v) for m, v in enumerate(base_values)], "ip_country string, month bigint, retention double")
    points = curve(spark, [("US", "p", 1, 0.5)], "ip_country string, price string, x bigint, y double")
    got = projection.stitched_curve(base, points, ["ip_country"], "price", horizon=3).orderBy("month").collect()
    chained = [0.5]
    for i in (1, 2):
        chained.append(chained[-1] * base_values[i] / base_values[i - 1])
    assert [r["retention"] for r in got] == pytest.approx(chained)
    total = projection.lt_cumulative(projection.stitched_curve(base, points, ["ip_country"], "price", horizon=3), ["price"])
    assert total.agg(F.max("lifetime")).first()[0] == pytest.approx(1.08333, abs=1e-5)


def test_flat_tail_and_value(spark):
    table = curve(spark, [("a", 0, 0.5), ("a", 1, 0.5)], "user_segment string, month bigint, hazard double")
    users = curve(spark, [("a", 3)], "user_segment string, users bigint")
    row = projection.lt_horizons(table, users).first()
    assert (row["lt_1"], row["lt_3"], row["lt_12"], row["users"]) == (Decimal("0.50"), Decimal("1.00"), Decimal("3.25"), 3)
    value = projection.ltv_cumulative(table, P, months=3).orderBy("month").collect()
    assert [r["ltv"] for r in value] == pytest.approx([0.5 * 39.95, 0.75 * 39.95, 1.0 * 39.95])


def exact_mode(table, segments, months, sd=1.5, step=0.2):
    """Posterior mode by Newton steps on (intercept, segment effects, walk steps)."""
    x, y, n = [], [], []
    for s, m, risk, events in table:
        x.append([1.0] + [sd * (s == g) for g in segments] + [step * (m >= j) for j in range(1, months + 1)])
        y.append(events)
        n.append(risk)
    x, y, n = np.array(x), np.array(y, float), np.array(n, float)
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    theta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ theta))
        change = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (y - n * p) - ridge @ theta)
        theta = theta + change * min(1, 2 / np.abs(change).max())
        if np.abs(change).max() < 1e-11:
            break
    return {(s, m): 1 / (1 + np.exp(-(theta[0] + sd * theta[1 + i] + step * theta[1 + len(segments):1 + len(segments) + m].sum())))
            for i, s in enumerate(segments) for m in range(months + 1)}


def test_hazard_is_the_posterior_mode(spark):
    rng = np.random.default_rng(1)
    table = []
    for s, level in (("B2B", -1.5), ("B2C", -0.7)):
        risk = 2000
        for m in range(8):
            events = int(rng.binomial(risk, 1 / (1 + np.exp(-(level - 0.1 * m)))))
            table.append((s, m, risk, events))
            risk -= events
    life = curve(spark, table, "user_segment string, month bigint, n_risk bigint, n_event bigint")
    want = exact_mode(table, ["B2B", "B2C"], 7)
    got = {(r["user_segment"], r["month"]): r["hazard"] for r in hazard.segment_hazard(life).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-5


def test_hazard_with_many_segments_and_months(spark):
    """Every month has a step of its own, and there is no bound on segments; gaps and early ends included."""
    rng = np.random.default_rng(2)
    table = []
    for i in range(120):
        risk, level = int(rng.integers(20, 4000)), rng.normal(-3, 1)
        for m in range(int(rng.integers(1, 150)) if i else 150):
            events = int(rng.binomial(risk, 1 / (1 + np.exp(-(level + 0.3 * np.sin(m / 9))))))
            if risk:
                table.append((f"s{i:03}", m, risk, events))
            risk -= events
    life = curve(spark, table, "user_segment string, month bigint, n_risk bigint, n_event bigint")
    last = max(r[1] for r in table)
    want = exact_mode(table, sorted({r[0] for r in table}), last)
    got = {(r["user_segment"], r["month"]): r["hazard"] for r in hazard.segment_hazard(life).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-6


def test_published_lifetimes(spark):
    dim = projection.published_lifetimes(spark)
    assert dim.count() == dim.select("country", "price").distinct().count() == 15
    assert dim.where("country = 'GB' and price = 49.95").first()["lt_36m"] == Decimal("2.05")


def sampled(table, segments, months, sd=1.5, step=0.2, rounds=60_000, seed=3):
    """Logits of (segment, month) from a long Metropolis walk, one coordinate after the other."""
    rng = np.random.default_rng(seed)
    n, y = np.zeros((len(segments), months + 1)), np.zeros((len(segments), months + 1))
    for s, m, risk, events in table:
        n[segments.index(s), m], y[segments.index(s), m] = risk, events
    a, b = np.zeros(len(segments)), np.full(months + 1, -1.0)
    log = lambda a, b: ((y * (a[:, None] + b) - n * np.logaddexp(0, a[:, None] + b)).sum()
                        - (a**2).sum() / (2 * sd**2) - (np.diff(b)**2).sum() / (2 * step**2))
    now, kept = log(a, b), []
    for k in range(rounds):
        for which in (0, 1, 2):
            a2, b2 = a.copy(), b.copy()
            if which == 0:
                a2[rng.integers(len(a))] += rng.normal(0, 0.4)
            elif which == 1:
                b2[rng.integers(len(b))] += rng.normal(0, 0.25)
            else:
                shift = rng.normal(0, 0.5)
                a2, b2 = a2 + shift, b2 - shift * rng.choice([1.0, 0.8])
            new = log(a2, b2)
            if np.log(rng.random()) < new - now:
                a, b, now = a2, b2, new
        if k > 5000:
            kept.append(a[:, None] + b)
    return np.array(kept)


def test_posterior_means_and_intervals_against_a_sampler(spark):
    """Few subscriptions, so that means and modes differ."""
    table = [("a", 0, 40, 12), ("a", 1, 28, 3), ("a", 2, 25, 2), ("a", 3, 9, 0), ("b", 0, 12, 1), ("b", 1, 11, 0), ("b", 3, 4, 1), ("c", 0, 5, 5)]
    life = curve(spark, table, "user_segment string, month bigint, n_risk bigint, n_event bigint").repartition(3)
    draws = sampled(table, ["a", "b", "c"], 3)
    got = {(r["user_segment"], r["month"]): r for r in hazard.segment_posterior(life, draws=6000).collect()}
    logit = lambda p: np.log(p / (1 - p))
    assert got.keys() == {(s, m) for s in "abc" for m in range(4)}
    for i, s in enumerate("abc"):
        for m in range(4):
            own, r = draws[:, i, m], got[s, m]
            spread = own.std()
            assert abs(logit(r["hazard"]) - own.mean()) < 0.12 * spread, (s, m)
            for bound, q in ((r["low"], 0.025), (r["high"], 0.975)):
                assert abs(logit(bound) - np.quantile(own, q)) < 0.3 * spread, (s, m, q)


def test_hazard_in_factored_form(spark, monkeypatch):
    """Fewer columns than segments give the same mode; many months stay a few columns wide."""
    rng = np.random.default_rng(6)
    table = [(f"s{i}", m, int(r), int(rng.binomial(r, 0.2))) for i in range(14) for m in range(6) if (r := rng.integers(1, 300)) and m <= i % 6]
    life = curve(spark, table, "user_segment string, month bigint, n_risk bigint, n_event bigint")
    want = exact_mode(table, sorted({r[0] for r in table}), 5)
    monkeypatch.setattr(hazard, "RANK", 2)
    got = {(r["user_segment"], r["month"]): r["hazard"] for r in hazard.segment_hazard(life).collect()}
    assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in want) < 1e-6


def test_hazard_with_an_absurd_tenure(spark):
    """20,000 months: nothing months x months is held anywhere."""
    table = [("a", m, 500, 20) for m in range(30)] + [("b", m, 300, 30) for m in range(12)] + [("b", 19_999, 3, 1)]
    life = curve(spark, table, "user_segment string, month bigint, n_risk bigint, n_event bigint")
    fit = hazard.fit_segment_hazard(life)
    assert len(fit.months) == 20_000 and fit.matrix.turn.shape[1] <= hazard.RANK
    # Without data between them the walk is a straight line.
    between = fit.months[30:19_999]
    assert np.abs(np.diff(between, 2)).max() < 1e-6
