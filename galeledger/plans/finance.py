"""Cash flow, NPV, IRR and the yearly driver table per scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import as_col, total, weighted_mean
from .costs import debt_service, opex_rate, with_capex, with_financing
from ..functions.units import mw_to_kw

RESIDUAL_SHARE = 0.30
IRR_GUESS, IRR_STEPS, IRR_BOUNDS = 0.08, 200, (-0.99, 5.0)
IRR_GRID, BISECTIONS = 128, 60


def financed(scenarios: DataFrame) -> DataFrame:
    """Scenario rows with cost and financing columns; equity defaults to 15 % of CAPEX."""
    out = with_financing(with_capex(scenarios))
    return out.withColumn("equity_in_eur", F.coalesce(F.col("equity_eur").cast("double"), 0.15 * F.col("capex_eur")))


def cash_flows(financed_rows: DataFrame, monthly: DataFrame, key: str = "scenario_id", years: int = 20) -> DataFrame:
    """One row per scenario with ``cash_flow``: equity at t=0, then the yearly surplus,
    the residual value added to the last year; and ``flow_reason``.

    A scenario that lacks months of revenue has no cash flow, and the reason says since which year: months that
    are not there are no months without revenue. Revenue is folded to one row per scenario by a single aggregate with one sum per
    year, so 240 monthly rows shrink to one before anything is shuffled.
    """
    of_year = lambda y, c: F.when(F.col("project_year") == y, c)
    by_year = monthly.groupBy(key).agg(
        *[F.coalesce(F.sum(of_year(y, F.col("revenue_eur"))), F.lit(0.0)).alias(f"_r{y}") for y in range(1, years + 1)],
        F.array(*[F.count(of_year(y, F.lit(1))) for y in range(1, years + 1)]).alias("_months"),
    )
    rows = financed_rows.join(by_year, key, "left")
    short = F.array_position(F.transform("_months", lambda n: n < 12), F.lit(True))
    reason = F.when(F.col("_months").isNull(), "no revenue").when(short > 0, F.concat(F.lit("revenue is incomplete in project year "), short.cast("string")))
    flow = [-F.col("equity_in_eur")]
    for y in range(1, years + 1):
        cf = F.col(f"_r{y}") - mw_to_kw("park_mw") * opex_rate(F.lit(y)) - debt_service(F.lit(y))
        flow.append(cf + RESIDUAL_SHARE * F.col("capex_eur") if y == years else cf)
    return rows.select(*financed_rows.columns, F.when(reason.isNull(), F.array(*flow)).alias("cash_flow"), reason.alias("flow_reason"))


def npv(cash_flow, rate) -> Column:
    flow, rate = as_col(cash_flow), as_col(rate)
    return F.aggregate(
        F.zip_with(flow, F.sequence(F.lit(0), F.size(flow) - 1), lambda c, t: c / F.pow(1.0 + rate, t)),
        F.lit(0.0), lambda a, x: a + x,
    )


def irr(cash_flow) -> Column:
    """Struct(rate, reason), folded inside the row: the root nearest to zero.

    With one sign change of the flows there is one root and Newton's method comes first; with more the
    grid below is searched at once, as several roots may lie in the bounds. Where Newton leaves the bounds or stalls (loss-making projects,
    flat slopes), the sign changes of NPV on a grid of rates are bracketed and the one
    nearest to zero is bisected. NULL with reason "no sign change" when all flows have
    one sign, and "no root in bounds" when NPV keeps its sign over the bounds.
    """
    flow = as_col(cash_flow)
    times = F.sequence(F.lit(0), F.size(flow) - 1)
    same_sign = F.forall(flow, lambda c: c >= 0) | F.forall(flow, lambda c: c <= 0)

    def value_and_slope(r: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("d"))
        pairs = F.zip_with(flow, times, lambda c, t: F.struct(
            (c / F.pow(1.0 + r, t)).alias("v"), (-t * c / F.pow(1.0 + r, t + 1)).alias("d")
        ))
        return F.aggregate(pairs, zero, lambda a, p: F.struct((a["v"] + p["v"]).alias("v"), (a["d"] + p["d"]).alias("d")))

    def state(r: Column, status: Column | str) -> Column:
        return F.struct(r.alias("r"), (F.lit(status) if isinstance(status, str) else status).alias("s"))

    def step(acc: Column, _i: Column) -> Column:
        # A one-element transform evaluates value and slope once per step.
        nxt = F.transform(F.array(value_and_slope(acc["r"])), lambda e: F.when(
            F.abs(e["v"]) < 1e-6, state(acc["r"], "ok")
        ).when(F.abs(e["d"]) < 1e-12, state(acc["r"], "no convergence")).otherwise(
            F.transform(F.array(acc["r"] - e["v"] / e["d"]), lambda rn: F.when(
                (rn <= IRR_BOUNDS[0]) | (rn >= IRR_BOUNDS[1]), state(rn, "out of bounds")
            ).otherwise(F.when(F.abs(rn - acc["r"]) < 1e-9, state(rn, "ok")).otherwise(state(rn, "run"))))[0]
        ))[0]
        return F.when(acc["s"] == "run", nxt).otherwise(acc)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(IRR_STEPS)), state(F.lit(IRR_GUESS), "run"), step)
    outcome = lambda rate, reason: F.struct(rate.alias("rate"), reason.alias("reason"))
    none = F.lit(None).cast("double")

    def finish(s: Column) -> Column:
        bisected = F.transform(F.array(_bisected(flow)), lambda b: outcome(b, F.when(b.isNull(), "no root in bounds").otherwise("ok")))[0]
        return F.when((s["s"] == "ok") & (_sign_changes(flow) <= 1), outcome(s["r"], F.lit("ok"))).otherwise(bisected)

    # One-element transforms keep the folds from being evaluated once per use.
    result = F.transform(F.array(solved), finish)[0]
    return F.when(same_sign, outcome(none, F.lit("no sign change"))).otherwise(result)


def _sign_changes(flow: Column) -> Column:
    """How often the sign changes along the flows that are not zero."""
    signs = F.transform(F.filter(flow, lambda c: c != 0), lambda c: F.signum(c))
    return F.transform(F.array(signs), lambda s: F.size(F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: a != b), lambda x: x)))[0]


def _bisected(flow: Column) -> Column:
    """Root of NPV nearest to zero between the bounds, or NULL. The grid is even in log(1 + rate)."""
    low, high = 1.0 + IRR_BOUNDS[0], 1.0 + IRR_BOUNDS[1]
    rate_at = lambda i: F.pow(F.lit(high / low), i / float(IRR_GRID)) * low - 1.0
    grid = F.transform(F.sequence(F.lit(0), F.lit(IRR_GRID)), lambda i: F.struct(rate_at(i).alias("r"), npv(flow, rate_at(i)).alias("v")))
    pairs = F.transform(F.array(grid), lambda g: F.zip_with(F.slice(g, 1, IRR_GRID), F.slice(g, 2, IRR_GRID), lambda a, b: F.struct(
        F.least(F.abs(a["r"]), F.abs(b["r"])).alias("near"), a["r"].alias("lo"), b["r"].alias("hi"), a["v"].alias("v"), (F.signum(a["v"]) * F.signum(b["v"]) <= 0).alias("cross")
    )))[0]
    best = F.array_min(F.filter(pairs, lambda p: p["cross"]))

    def halve(acc: Column, _i: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        same = F.signum(npv(flow, mid)) == F.signum(acc["v"])
        return F.struct(F.when(same, mid).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(mid).alias("hi"), acc["v"].alias("v"))

    narrowed = lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["v"].alias("v")), halve, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.transform(F.array(best), lambda b: F.when(b.isNotNull(), narrowed(b)))[0]


def valued(flows: DataFrame) -> DataFrame:
    """Adds discount_rate_used, npv_eur, irr and irr_reason."""
    rate = F.coalesce(F.col("discount_rate"), F.col("wacc")) if "discount_rate" in flows.columns else F.col("wacc")
    out = flows.withColumn("discount_rate_used", rate).withColumn("_irr", irr("cash_flow"))
    return out.withColumns({
        "npv_eur": npv("cash_flow", "discount_rate_used"), "irr": F.col("_irr.rate"), "irr_reason": F.col("_irr.reason"),
    }).drop("_irr")


def yearly_table(financed_rows: DataFrame, monthly: DataFrame, key: str = "scenario_id", years: int = 20) -> DataFrame:
    """(key, year, mwh_gross, market price, cf, cr, opex, debt service, profit).

    ``mwh_gross`` is the delivered energy, which also weights the market price.
    """
    drivers = monthly.groupBy(key, F.col("project_year").alias("year")).agg(
        total("mwh_delivered").alias("mwh_gross"), weighted_mean("p_market", "mwh_delivered").alias("market_price_electricity"),
        F.avg("cf").alias("cf"), F.avg("cr").alias("cr"), total("revenue_eur").alias("_revenue"),
    )
    spine = financed_rows.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    rows = spine.join(drivers, [key, "year"], "left")
    opex, debt = mw_to_kw("park_mw") * opex_rate("year"), debt_service("year")
    profit = F.coalesce("_revenue", F.lit(0.0)) - opex - debt
    return rows.select(
        key, "year", "mwh_gross", "market_price_electricity", "cf", "cr", opex.alias("opex"), debt.alias("debt_service"), profit.alias("profit"),
    )
