"""Monthly energy of the past to production of the future: simulations, bands, one representative path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.units import kwh_to_mwh
from ..operators.aggregate import quantile_bands
from ..operators.simulate import bootstrap_by_month, representative_path
from ..session import settle
from .energy import historical_monthly_energy

N_SIMS, START_YEAR, YEARS, SEED = 500, 2026, 20, 42


@dataclass
class EnergyForecast:
    """``history``: (keys, year, month, energy_kwh); ``simulations``: (keys, sim, ts, energy_kwh); ``bands``: (keys, ts, p10, p50, p90);
    ``representative``: (keys, ts, energy_kwh) of the simulation whose total is nearest to the median total."""

    keys: tuple[str, ...]
    history: DataFrame
    simulations: DataFrame
    bands: DataFrame
    representative: DataFrame


def energy_forecast(history: DataFrame, keys: Sequence[str], n_sims: int = N_SIMS, start_year: int = START_YEAR, years: int = YEARS, seed: int = SEED) -> EnergyForecast:
    """Bootstrap of calendar months of a history, per key. A key without history for a calendar month raises.

    Draws are hashes, so simulations are computed anew wherever they are used and are the same each time.
    """
    known = settle(history.select(*keys, "year", "month", "energy_kwh"), "energy-history")
    sims = bootstrap_by_month(known, keys, n_sims, start_year, years, seed)
    return EnergyForecast(tuple(keys), known, sims, quantile_bands(sims, [*keys, "ts"], "energy_kwh"), representative_path(sims, keys).select(*keys, "ts", "energy_kwh"))


def forecast_sites(sites: DataFrame, grid: DataFrame, catalogue: DataFrame, model: PipelineModel, step: float, key: str = "site_id", min_hours: int = 24 * 28, **horizon) -> EnergyForecast:
    """From climate grid, power curves and correction model to the forecast of every site."""
    return energy_forecast(historical_monthly_energy(sites, grid, catalogue, model, step, key, min_hours), [key], **horizon)


def covering(scenarios: DataFrame, start: str = "cod", months: int = YEARS * 12) -> dict[str, int]:
    """Start year and years of a forecast that covers the horizon of every scenario."""
    first, last = scenarios.agg(F.year(F.min(start)), F.year(F.add_months(F.max(start), months - 1))).first()
    return {"start_year": first, "years": last - first + 1}


def scenario_production(scenarios: DataFrame, forecast: EnergyForecast, key: str = "scenario_id", months: int = YEARS * 12) -> DataFrame:
    """(key, date, mwh) for the revenue job: the representative path of a scenario's site, times its turbines, over its horizon.

    ``scenarios``: key, the keys of the forecast, n_turbines and cod. A site without forecast gives no rows, which the revenue job reports.
    """
    path = forecast.representative.withColumnRenamed("ts", "date")
    rows = scenarios.select(key, *forecast.keys, "n_turbines", "cod").join(path, list(forecast.keys))
    rows = rows.where((F.col("date") >= F.trunc("cod", "month")) & (F.col("date") < F.add_months(F.trunc("cod", "month"), months)))
    return rows.select(key, "date", (F.col("n_turbines") * kwh_to_mwh("energy_kwh")).alias("mwh"))
