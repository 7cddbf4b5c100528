"""Capital, operating and financing cost as columns of the scenario table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import as_col, clip
from ..functions.units import mw_to_kw, yearly_to_monthly
from ..functions.wind import swept_area
from ..sources.catalogue import ARCHETYPES, OPEX_RATES

# Balance-of-plant EUR/kW and the coefficients of the turbine cost line
# (intercept, per MW, per W/m2 of specific rating, per metre of hub height).
BALANCE_OF_PLANT = 551.0
TURBINE_COST = (1476.19, -65.62, -1.29, 3.50)
DEFAULT_EQUITY_SHARE = 0.15
MAX_EQUITY_SHARE = 0.999999


def capex_columns(p_mw, rotor_m, hub_m, n_turbines) -> dict[str, Column]:
    p_mw = as_col(p_mw)
    rating = p_mw * 1_000_000.0 / swept_area(rotor_m)
    base, per_mw, per_rating, per_metre = TURBINE_COST
    turbine = base + per_mw * p_mw + per_rating * rating + per_metre * as_col(hub_m)
    park_mw = as_col(n_turbines).cast("double") * p_mw
    return {
        "park_mw": park_mw,
        "sfl": rating,
        "turbine_capex_eur_per_kw": turbine,
        "capex_eur_per_kw": turbine + BALANCE_OF_PLANT,
        "capex_eur": mw_to_kw(park_mw) * (turbine + BALANCE_OF_PLANT),
    }


def with_capex(scenarios: DataFrame) -> DataFrame:
    """Adds turbine archetype and CAPEX columns (n_turbines, turbine_type_id, hub_height_m)."""
    pick = lambda field: F.coalesce(*[F.when(F.col("turbine_type_id") == a[0], F.lit(a[field])) for a in ARCHETYPES])
    out = scenarios.withColumns({"turbine_type": pick(1), "p_mw": pick(2), "rotor_diameter_m": pick(3)})
    return out.withColumns(capex_columns("p_mw", "rotor_diameter_m", "hub_height_m", "n_turbines"))


def opex_rate(project_year) -> Column:
    """EUR per kW and year, a step function of the project year."""
    year, rate = as_col(project_year), F.lit(OPEX_RATES[0][1])
    for start, value in OPEX_RATES[1:]:
        rate = F.when(year >= start, F.lit(value)).otherwise(rate)
    return rate


def opex_by_year(scenarios: DataFrame, keys, months: int = 240) -> DataFrame:
    """(keys, project_year, annual_opex_eur, opex_eur_per_kw_year, months_in_year).

    The months of a year share one rate, so a year is its monthly cost times its
    number of months; only the last year can be partial.
    """
    years = -(-months // 12)
    rows = scenarios.withColumn("project_year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    in_year = F.least(F.lit(12), F.lit(months) - (F.col("project_year") - 1) * 12)
    rate = opex_rate("project_year")
    return rows.select(
        *keys, "project_year", (yearly_to_monthly(mw_to_kw("park_mw") * rate) * in_year).alias("annual_opex_eur"),
        rate.alias("opex_eur_per_kw_year"), in_year.cast("bigint").alias("months_in_year"),
    )


def opex_total(park_mw, months: int = 240) -> Column:
    years = range(1, -(-months // 12) + 1)
    return sum((yearly_to_monthly(mw_to_kw(park_mw) * opex_rate(F.lit(y))) * min(12, months - (y - 1) * 12) for y in years), F.lit(0.0))


def equity_share(equity_eur, capex_eur, share=None) -> Column:
    """equity / capex, else the given share, else the default; kept below 1."""
    given = F.lit(None).cast("double") if share is None else as_col(share)
    return clip(F.coalesce(as_col(equity_eur) / as_col(capex_eur), given, F.lit(DEFAULT_EQUITY_SHARE)), 0.0, MAX_EQUITY_SHARE)


def annuity(debt, rate, years) -> Column:
    """Constant yearly payment; straight division at a zero rate, nothing without debt."""
    debt, rate, years = as_col(debt), as_col(rate), as_col(years)
    growth = F.pow(1.0 + rate, years)
    return F.when(debt <= 0, 0.0).when(rate == 0, debt / years).otherwise(debt * (rate * growth / (growth - 1.0)))


def with_financing(df: DataFrame) -> DataFrame:
    """Adds equity/debt split, debt service, interest and WACC to rows that carry
    capex_eur, equity_eur, debt_rate, equity_return and debt_tenor_years."""
    share = F.col("equity_share_used")
    out = df.withColumn("equity_share_used", equity_share("equity_eur", "capex_eur"))
    out = out.withColumns({
        "equity_eur_final": F.col("capex_eur") * share,
        "debt_eur": F.col("capex_eur") * (1.0 - share),
        "wacc": share * F.col("equity_return") + (1.0 - share) * F.col("debt_rate"),
    })
    out = out.withColumn("annual_debt_service_eur", annuity("debt_eur", "debt_rate", "debt_tenor_years"))
    interest = F.col("annual_debt_service_eur") * F.col("debt_tenor_years") - F.col("debt_eur")
    return out.withColumn("total_interest_eur", F.when(F.col("debt_eur") > 0, interest).otherwise(0.0))


def debt_service(project_year) -> Column:
    """Payment while the loan runs."""
    return F.when(as_col(project_year) <= F.col("debt_tenor_years"), F.col("annual_debt_service_eur")).otherwise(0.0)
