"""Projection: power-law fits, base curves, price stitching, lifetime reports.

Input is a handful of points per group (at most one per renewal cycle); the heavy work is the
aggregation that produced them.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions.columns import day, money, power_law, safe_div
from kohorte.operators.retention import by_month, heads, maturity_days, observed_points, running_product
from kohorte.params import Params
from kohorte.session import cut_lineage

# ------------------------------------------------------------------------- fit


def power_law_loglog(points: DataFrame, keys: Sequence[str], *, min_points: int = 3) -> DataFrame:
    """(alpha, beta) of y = alpha * x^beta by least squares on logarithms; needs positive points."""
    lx, ly = F.log(F.col("x").cast("double")), F.when(F.col("y") > 0, F.log("y"))
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.exp(F.regr_intercept(ly, lx)).alias("alpha"),
        F.regr_slope(ly, lx).alias("beta")).where(F.col("n_points") >= min_points)


def _best_alpha(points: Column, beta: Column) -> Column:
    """The factor that minimises the squared error for a given exponent."""
    sums = F.aggregate(
        points, F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx")),
        lambda acc, q: F.struct((acc["xy"] + q["y"] * F.pow(q["x"], beta)).alias("xy"),
                                (acc["xx"] + F.pow(q["x"], beta * 2)).alias("xx")))
    return F.aggregate(F.array(sums), F.lit(0.0), lambda _, s: safe_div(s["xy"], s["xx"]))


def _gauss_newton_step(points: Column, alpha: Column, beta: Column, largest: float) -> Column:
    """Change of the exponent from the two-parameter normal equations, limited to ``largest``."""
    def add(acc: Column, q: Column) -> Column:
        u = F.pow(q["x"], beta)
        v = alpha * u * F.log(q["x"])
        miss = q["y"] - alpha * u
        return F.struct(
            (acc["uu"] + u * u).alias("uu"), (acc["uv"] + u * v).alias("uv"), (acc["vv"] + v * v).alias("vv"),
            (acc["ug"] + u * miss).alias("ug"), (acc["vg"] + v * miss).alias("vg"))

    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("uu", "uv", "vv", "ug", "vg")])
    change = F.aggregate(F.array(F.aggregate(points, zero, add)), F.lit(0.0), lambda _, s: safe_div(
        s["uu"] * s["vg"] - s["uv"] * s["ug"], s["uu"] * s["vv"] - s["uv"] * s["uv"]))
    return F.greatest(F.lit(-largest), F.least(F.lit(largest), change))


def power_law_fit(points: DataFrame, keys: Sequence[str], *, min_points: int = 3, start_beta: float = -0.5,
                  steps: int = 30, largest_step: float = 0.5) -> DataFrame:
    """(alpha, beta) minimising the squared error of y = alpha * x^beta per group; groups that fail drop out.

    Starts from the log-log line (from ``start_beta`` where a point is not positive) and repeats Gauss-Newton
    steps on the exponent, with the factor solved exactly each time. The points of a group are one short
    array, so the fit is an expression and needs no Python worker.
    """
    lx = F.log(F.col("x").cast("double"))
    ly = F.when(F.col("y") > 0, F.log("y"))
    grouped = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").alias("y")))).alias("points"),
        F.when(F.min("y") > 0, F.regr_slope(ly, lx)).alias("slope"))
    grouped = grouped.where(F.size("points") >= min_points).withColumn(
        "start", F.coalesce("slope", F.lit(start_beta)))
    pts = F.col("points")

    def step(state: Column, _: Column) -> Column:
        beta = state["beta"] + _gauss_newton_step(pts, state["alpha"], state["beta"], largest_step)
        return F.struct(_best_alpha(pts, beta).alias("alpha"), beta.alias("beta"))

    start = F.struct(_best_alpha(pts, F.col("start")).alias("alpha"), F.col("start").alias("beta"))
    fitted = grouped.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    usable = ~F.isnan("fit.alpha") & ~F.isnan("fit.beta") & (F.abs("fit.beta") < 1e6)
    return fitted.where(usable).select(
        *keys, F.size("points").cast("bigint").alias("n_points"), F.col("fit.alpha").alias("alpha"),
        F.col("fit.beta").alias("beta"))


# ---------------------------------------------------------------------- curves


def base_curve(points: DataFrame, fits: DataFrame, keys: Sequence[str], *, horizon: int, keep_observed: bool = True) -> DataFrame:
    """(keys, month 1..horizon) -> observed share where there is one, else the fitted power law."""
    spine = fits.select(*keys, "alpha", "beta", F.explode(F.sequence(F.lit(1), F.lit(horizon)).cast("array<bigint>")).alias("month"))
    law = power_law(F.col("month"), F.col("alpha"), F.col("beta"))
    if not keep_observed:
        return spine.select(*keys, "month", law.alias("retention"))
    seen = points.select(*keys, F.col("x").alias("month"), F.col("y").alias("seen"))
    return spine.join(seen, [*keys, "month"], "left").select(*keys, "month", F.coalesce("seen", law).alias("retention"))


def stitched_curve(base: DataFrame, points: DataFrame, keys: Sequence[str], scenario: str, *, horizon: int) -> DataFrame:
    """(keys, scenario, month) -> observed shares of a new price, continued with the monthly rates of the base curve.

    From the last observed month k on, s(m) = s(k) * base(m) / base(k): the product of the base curve's
    month-to-month rates, without walking the months. With empty ``keys`` one base curve serves every scenario.
    """
    who = [*keys, scenario]
    months = F.sequence(F.lit(1), F.lit(horizon)).cast("array<bigint>")
    last = points.groupBy(*who).agg(F.max("x").alias("k"), F.max_by("y", "x").alias("at_k"))
    anchor = base.select(*keys, F.col("month").alias("k"), F.col("retention").alias("base_k"))
    seen = points.select(*who, F.col("x").alias("month"), F.col("y").alias("seen"))
    joined = (
        last.withColumn("month", F.explode(months)).join(base, [*keys, "month"]).join(anchor, [*keys, "k"])
        .join(seen, [*who, "month"], "left"))
    carried = F.col("at_k") * safe_div(F.col("retention"), F.col("base_k"))
    return joined.select(*who, "month", F.when(F.col("month") <= F.col("k"), F.col("seen")).otherwise(carried).alias("retention"))


def lt_cumulative(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the lifetime up to each month."""
    upto = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("lifetime", F.sum("retention").over(upto))


# --------------------------------------------------------------------- reports


def price_split(prepared: DataFrame, p: Params, *, baseline_age: int = 0) -> tuple[DataFrame, DataFrame]:
    """Baseline rows (before the first price change) and rows on a new price since its date, tagged ``price``."""
    changes = sorted(p.price_dates.items(), key=lambda kv: kv[1])
    began = F.col("started")
    baseline = prepared.where((began < day(changes[0][1])) & (F.col("account_age_days") >= baseline_age))
    on_new = None
    for price, since in changes:
        rule = (began >= day(since)) & (F.col("amount") == F.lit(Decimal(price)).cast("decimal(10,2)"))
        on_new = rule if on_new is None else on_new | rule
    return baseline, prepared.where(on_new).withColumn("price", F.col("amount"))


def _points(prepared: DataFrame, keys: Sequence[str], *, cycles: int, at_least: int, rule: str = "second") -> DataFrame:
    found = observed_points(prepared, keys, cycles=cycles, rule=rule, at_least=at_least)
    return found.select(*keys, F.col("r").alias("x"), F.col("retention").alias("y"), "eligible")


def curve_points(prepared: DataFrame, p: Params) -> DataFrame:
    """(country, x, y) -> share retained at renewal x, as far as there are enough subscriptions."""
    return _points(prepared, ["ip_country"], cycles=p.max_cycles, at_least=p.min_curve_users)


def country_base(prepared: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(points, base curve) per country of baseline rows. Both are a few rows per country that several later steps
    read, so each is stored once."""
    keys = ["ip_country"]
    points = cut_lineage(curve_points(prepared, p))
    fits = power_law_fit(points, keys, min_points=p.min_curve_points)
    return points, cut_lineage(base_curve(points, fits, keys, horizon=p.horizon))


def scenario_curves(prepared: DataFrame, p: Params, *, countries: Sequence[str] | None = None, min_volume: int = 0,
                    baseline_age: int = 0, new_cycles: int = 1) -> DataFrame:
    """(country, scenario, month) -> share, sample size. Baseline curves and the new prices stitched to them."""
    baseline, new = price_split(prepared, p, baseline_age=baseline_age)
    if countries is not None:
        baseline = baseline.where(F.col("ip_country").isin(list(countries)))
    mature = maturity_days(1, "second")
    sizes = baseline.groupBy("ip_country").agg(
        heads(baseline).alias("rows"), heads(baseline, F.col("account_age_days") >= mature).alias("mature"))
    sizes = sizes.where(F.col("rows") >= min_volume)
    _, base = country_base(baseline, p)
    base = base.join(sizes.select("ip_country"), "ip_country", "left_semi")
    points = cut_lineage(_points(new, ["ip_country", "price"], cycles=new_cycles, at_least=p.min_eligible))
    stitched = stitched_curve(base, points, ["ip_country"], "price", horizon=p.horizon)
    sample = points.where(F.col("x") == 1).select("ip_country", "price", F.col("eligible").alias("rows"),
                                                  F.col("eligible").alias("mature"))
    old = base.join(sizes, "ip_country").withColumn("price", F.lit(None).cast("decimal(10,2)"))
    return old.unionByName(stitched.join(sample, ["ip_country", "price"]))


def scenario_report(curves: DataFrame, p: Params, *, baseline_name: str = k.BASELINE_SCENARIO,
                    prefix: str = k.PRICE_SCENARIO) -> DataFrame:
    """One row per country and scenario: sample size, lifetime over the horizon, cumulative lifetime per month."""
    name = F.coalesce(F.concat(F.lit(prefix), F.col("price").cast("string")), F.lit(baseline_name))
    rows = lt_cumulative(curves.withColumn("scenario", name), ["ip_country", "scenario"])
    wide = rows.groupBy("ip_country", "scenario", F.col("rows").alias("sample_size")).agg(
        F.sum("retention").alias("lt_36m"),
        *[F.max(F.when(F.col("month") == m, F.col("lifetime"))).alias(f"month_{m}") for m in range(1, p.horizon + 1)])
    return wide.withColumnRenamed("ip_country", "country")


def published_lifetimes(spark: SparkSession) -> DataFrame:
    """The published projection as a constant dimension of the same shape as :func:`ltv_projection_dim`."""
    return spark.createDataFrame(k.PUBLISHED_LIFETIMES, "country string, price decimal(10,2), lt_36m decimal(18,2)")


def ltv_projection_dim(curves: DataFrame, p: Params) -> DataFrame:
    """(country, price) -> 36-month lifetime and number of mature subscriptions. Small; written as a dimension."""
    price = F.coalesce("price", F.lit(Decimal(p.price_points[0])).cast("decimal(10,2)"))
    return curves.groupBy(F.col("ip_country").alias("country"), price.alias("price")).agg(
        money(F.sum("retention")).alias("lt_36m"), F.max("mature").alias("n"))


def price_curves(prepared: DataFrame, p: Params, *, base_users: int = 100, new_users: int = 50, new_cycles: int = 3) -> DataFrame:
    """(price, month 1..horizon) over all countries, the trial being month 1: the oldest price as fitted power law,
    newer prices observed and continued with its rates."""
    cells = prepared.where(F.col("ip_country").isin(list(p.model_countries)))
    base_price, *new_prices = [Decimal(x) for x in p.price_points]

    def points(prices: Sequence[Decimal], cycles: int, users: int) -> DataFrame:
        found = _points(cells.where(F.col("amount").isin(list(prices))), ["amount"], cycles=cycles, at_least=users, rule="first")
        trial = cells.sparkSession.createDataFrame([(x,) for x in prices], "amount decimal(10,2)").select(
            "amount", F.lit(1).cast("bigint").alias("x"), F.lit(1.0).alias("y"))
        return trial.unionByName(found.select("amount", (F.col("x") + 1).alias("x"), "y"))

    old = points([base_price], p.max_cycles, base_users)
    fits = power_law_fit(old, ["amount"], min_points=2)
    base = cut_lineage(base_curve(old, fits, ["amount"], horizon=p.horizon, keep_observed=False))
    new = stitched_curve(base.drop("amount"), cut_lineage(points(new_prices, new_cycles, new_users)), [], "amount",
                         horizon=p.horizon)
    return base.unionByName(new.select(*base.columns))


def curve_detail(curves: DataFrame, p: Params) -> DataFrame:
    """Cycle -> retained percentage and cumulative lifetime, a pair of columns per price."""
    rows = lt_cumulative(curves, ["amount"])
    def cell(price, value: Column) -> Column:
        return F.max(F.when(F.col("amount") == F.lit(Decimal(price)).cast("decimal(10,2)"), value))
    columns = []
    for price in p.price_points:
        tag = str(price).replace(".", "_")
        columns += [cell(price, money(F.col("retention") * 100)).alias(f"retention_pct_{tag}"),
                    cell(price, F.round(F.col("lifetime").cast("decimal(28,8)"), 4).cast("double")).alias(f"lt_{tag}")]
    return rows.groupBy(F.col("month").alias("cycle")).agg(*columns)


# ---------------------------------------------------------- lifetime from hazards


def survival_to(hazard: DataFrame, months: int, segment: str = "user_segment") -> DataFrame:
    """(segment, month 0..months-1) -> survival from monthly hazards; flat after the last observed month."""
    curve = hazard.withColumn("survival", running_product(1 - F.col("hazard"), by_month(segment)))
    spine = hazard.select(segment).distinct().select(
        segment, F.explode(F.sequence(F.lit(0), F.lit(months - 1)).cast("array<bigint>")).alias("month"))
    filled = F.last("survival", ignorenulls=True).over(by_month(segment))
    return spine.join(curve.select(segment, "month", "survival"), [segment, "month"], "left").select(
        segment, "month", filled.alias("survival"))


def lt_horizons(hazard: DataFrame, users: DataFrame, segment: str = "user_segment",
                horizons: Sequence[int] = (1, 3, 6, 12, 24, 36)) -> DataFrame:
    """Segment -> users and lifetime within each horizon."""
    curve = survival_to(hazard, max(horizons), segment)
    wide = curve.groupBy(segment).agg(
        *[money(F.sum(F.when(F.col("month") < m, F.col("survival")))).alias(f"lt_{m}") for m in horizons])
    return wide.join(users, segment)


def ltv_cumulative(hazard: DataFrame, p: Params, segment: str = "user_segment", *, months: int = 35) -> DataFrame:
    """(segment, month 1..months) -> cumulative value: revenue per user and month times lifetime so far."""
    curve = survival_to(hazard, months, segment).withColumnRenamed("survival", "retention")
    return lt_cumulative(curve, [segment]).select(
        segment, (F.col("month") + 1).alias("month"), (F.col("lifetime") * F.lit(float(p.arpu))).alias("ltv"))


def empirical_hazard(life_table: DataFrame, segment: str = "user_segment") -> DataFrame:
    return life_table.where(F.col("n_risk") > 0).select(
        segment, "month", (F.col("n_event").cast("double") / F.col("n_risk").cast("double")).alias("hazard"))
