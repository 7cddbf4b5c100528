"""Turbine catalogue and the small parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.checks import assert_none

CATALOGUE_SCHEMA = (
    "map<string, struct<name: string, manufacturer: string, rated_power_kw: double, rotor_diameter_m: double, "
    "default_hub_height_m: double, `Cut-in wind speed`: double, `Cut-out wind speed`: double, source: string, "
    "power_curve: array<array<double>>>>"
)
DEFAULT_CUT_IN = 3.5

# Grid operators by request id.
TSO_NAMES = {0: "50Hertz", 1: "TenneT", 2: "Amprion", 3: "TransnetBW"}
# Turbine archetypes (id, name, rated MW, rotor diameter m).
ARCHETYPES = [(0, "LOW_WIND", 6.0, 170.0), (1, "BALANCED", 5.6, 160.0), (2, "HIGH_WIND", 4.2, 130.0)]
# Operating cost in EUR per kW and year, by first project year.
OPEX_RATES = [(1, 53.0), (11, 55.0)]
# Yearly growth of wind output and load per operator.
WIND_GROWTH, LOAD_GROWTH = 0.01, 0.005
# Yearly growth of national wind output by scenario.
WIND_SCENARIOS = {"low": 0.005, "base": 0.015, "high": 0.030}
# Yearly price drift by scenario.
PRICE_DRIFTS = {"low": 0.03, "base": 0.05, "high": 0.07}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per turbine type with its nested power curve."""
    doc = spark.read.text(path, wholetext=True)
    return catalogue_rows(doc.select(F.col("value").alias("json")))


def catalogue_rows(docs: DataFrame) -> DataFrame:
    entries = docs.select(F.explode(F.from_json("json", CATALOGUE_SCHEMA)).alias("turbine_type", "s"))
    return entries.select(
        "turbine_type", F.col("s.rated_power_kw").alias("rated_power_kw"), F.col("s.rotor_diameter_m").alias("rotor_diameter_m"),
        F.col("s.default_hub_height_m").alias("default_hub_height_m"), F.col("s.`Cut-in wind speed`").alias("cut_in_ws"),
        F.col("s.`Cut-out wind speed`").alias("cut_out_ws"), F.col("s.power_curve").alias("power_curve"),
    )


def check_turbines(meta: DataFrame, catalogue: DataFrame) -> None:
    """Every turbine needs a catalogue type with a cut-in speed."""
    assert_none(meta.join(catalogue, "turbine_type", "left_anti").select("turbine_id", "turbine_type"), "turbine type not in catalogue")
    assert_none(catalogue.where("cut_in_ws IS NULL").select("turbine_type").join(meta, "turbine_type", "left_semi"), "cut-in speed missing")


def attach_turbines(df: DataFrame, meta: DataFrame, catalogue: DataFrame, default_hub_m: float | None = None, site_lat: float | None = None, site_lon: float | None = None) -> DataFrame:
    """Turbine constants on every row: metadata first, then the type's defaults, then
    the arguments."""
    spec = catalogue.drop("power_curve")
    dim = meta.join(spec, "turbine_type", "left").select(
        "turbine_id", "turbine_type", F.coalesce("lat", F.lit(site_lat)).alias("lat"), F.coalesce("lon", F.lit(site_lon)).alias("lon"),
        F.coalesce("hub_height_m", "default_hub_height_m", F.lit(default_hub_m)).alias("hub_height_m"),
        "rated_power_kw", "rotor_diameter_m", F.coalesce("cut_in_ws", F.lit(DEFAULT_CUT_IN)).alias("cut_in_ws"),
    )
    return df.join(dim, "turbine_id", "left")


def tso_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TSO_NAMES.items()), "tso_id int, tso string")


def archetype_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARCHETYPES, "turbine_type_id int, turbine_type string, p_mw double, rotor_diameter_m double")
