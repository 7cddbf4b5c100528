"""Registry, table access and the stand-in series built from the driver's tables.

Each stand-in exists twice: as a DataFrame method of :class:`Tables` and as the SQL
text of a CTE in :data:`CTE`, so an operator and its SQL twin start from equal rows.
Scale divisors are primes: a mean of cents over 4000 can end in an exact 5, where
engines round differently; over 3997 it cannot.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import month_start, quarter_start
from ..session import settle
from ..sources.catalogue import TSO_NAMES, catalogue_rows

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Stand-in turbine catalogue (three types, short curves) in the catalogue file's format.
CATALOGUE_JSON = """{
 "alpha": {"name": "Alpha", "manufacturer": "x", "rated_power_kw": 2000, "rotor_diameter_m": 90, "default_hub_height_m": 100,
  "Cut-in wind speed": 3.0, "Cut-out wind speed": 25.0, "source": "",
  "power_curve": [[3, 0], [5, 200], [8, 800], [12, 1990], [25, 2000], [25.5, 0]]},
 "beta": {"name": "Beta", "manufacturer": "x", "rated_power_kw": 3000, "rotor_diameter_m": 112, "default_hub_height_m": 120,
  "Cut-in wind speed": 3.5, "Cut-out wind speed": 25.0, "source": "",
  "power_curve": [[2.5, 0], [4, 120], [7.3, 900], [11, 2700], [13, 3000], [24, 3000]]},
 "gamma": {"name": "Gamma", "manufacturer": "x", "rated_power_kw": 1500, "rotor_diameter_m": 77, "default_hub_height_m": 80,
  "Cut-in wind speed": 3.5, "Cut-out wind speed": 25.0, "source": "",
  "power_curve": [[3.5, 18], [6, 300], [9, 980], [14, 1480]]}
}"""
TYPES = ["alpha", "beta", "gamma"]
GRID_STEP = 0.25


def r(c, n: int = 6) -> Column:
    """Rounded, because sums run in a different order on every engine."""
    return F.round(c if isinstance(c, Column) else F.col(c), n)


def rounded(df: DataFrame, columns, n: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, n) for c in columns})


class Tables:
    """Driver tables and stand-ins at one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def zone_hourly(self) -> DataFrame:
        """Weighted price samples per zone."""
        rows = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
            self.nation, F.col("s_nationkey") == F.col("n_nationkey")
        )
        return rows.select(
            F.col("n_name").alias("zone"), F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity") / 6.997).alias("price_eur_mwh"), F.col("l_quantity").alias("wind_mwh"),
        )

    def region_orders(self) -> DataFrame:
        rows = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(
            F.col("r_name").alias("tso"), F.col("n_name").alias("zone"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"
        )

    def region_month(self) -> DataFrame:
        """Monthly price and volume per operator."""
        return self.region_orders().groupBy("tso", month_start("o_orderdate").alias("month")).agg(
            (F.avg("o_totalprice") / 3997).alias("price"), (F.sum("o_totalprice") / 997).alias("wind_mwh"),
            (F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice") + 0.5).alias("capture_factor"),
        )

    def tso_quarter(self) -> DataFrame:
        """Curtailed, produced, wind and load volume per operator and quarter."""
        part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("o_totalprice"))), F.lit(0.0))
        rows = self.region_orders().groupBy("tso", quarter_start("o_orderdate").alias("quarter")).agg(
            part(F.col("o_orderstatus") == "F").alias("curt_mwh"), part(F.col("o_orderstatus") != "F").alias("prod_mwh"),
            part(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("wind_mwh"), F.sum("o_totalprice").alias("load_mwh"),
        )
        return rows.withColumn("cr", F.col("curt_mwh") / (F.col("curt_mwh") + F.col("prod_mwh"))).withColumn("S", F.col("wind_mwh") / F.col("load_mwh"))

    def telemetry(self) -> DataFrame:
        """Samples of ten turbines on two sites."""
        c = F.col
        return self.events.select(
            F.concat(F.lit("S"), (c("user_id") % 2).cast("string")).alias("site_id"),
            F.concat(F.lit("T"), (c("user_id") % 10).cast("string")).alias("turbine_id"),
            "ts", "event_id", "event_type", (c("value") * 10 / 0.997 - 20).alias("power_kw"), (c("value") / 0.997 % 25).alias("wind_speed_ms"),
            F.element_at(F.array(*[F.lit(x) for x in TYPES]), (c("user_id") % 10 % 3 + 1).cast("int")).alias("turbine_type"),
        )

    def catalogue(self) -> DataFrame:
        return catalogue_rows(self.spark.range(1).select(F.lit(CATALOGUE_JSON).alias("json")))

    def climate(self) -> DataFrame:
        """Daily fields on a 3 x 3 grid."""
        c = F.col
        rows = self.events.groupBy(
            F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("time"),
            (c("user_id") % 3 + 200).cast("int").alias("lat_i"), (F.floor(c("user_id") / 3) % 3 + 40).cast("int").alias("lon_i"),
        ).agg(F.avg("value").alias("a"), F.max("value").alias("b"), F.min("value").alias("m"), F.count(F.lit(1)).alias("k"))
        return rows.select(
            "time", "lat_i", "lon_i", (c("a") / 9.7 - 2).alias("u10"), (c("b") / 50 - 1).alias("v10"),
            (c("a") / 7.9 - 2).alias("u100"), (c("b") / 40 - 1).alias("v100"), (275 + c("a") / 9.7).alias("t2m"),
            (101325 - c("b") * 10).alias("sp"), (271 + c("a") / 19.7).alias("d2m"), (0.1 + c("k") * 0.001).alias("fsr"), (c("m") / 10).alias("zust"),
        )

    def sites(self) -> DataFrame:
        c = F.col("s_suppkey")
        return self.supplier.select(
            c.alias("site_id"), (50 + (c % 11) * 0.05).alias("lat"), (10 + (c % 13) * 0.05).alias("lon"), (80.0 + 10 * (c % 8)).alias("hub_height_m"),
            F.element_at(F.array(*[F.lit(x) for x in TYPES]), (c % 3 + 1).cast("int")).alias("turbine_type"),
        )

    def scenarios(self) -> DataFrame:
        c, k = F.col, F.col("s_suppkey")
        return self.supplier.select(
            k.alias("scenario_id"), (1 + k % 20).cast("int").alias("n_turbines"), (k % 3).cast("int").alias("turbine_type_id"),
            (100.0 + 10 * (k % 9)).alias("hub_height_m"), (k % 4).cast("int").alias("tso_id"),
            F.element_at(F.array(*[F.lit(TSO_NAMES[i]) for i in range(4)]), (k % 4 + 1).cast("int")).alias("tso"),
            F.make_date((1996 + k % 3).cast("int"), (1 + k % 12).cast("int"), F.lit(1)).alias("cod"),
            (k % 2).cast("int").alias("eeg_on"), F.when(k % 5 == 0, 60 + c("s_acctbal") / 997).alias("manual_eeg_strike"),
            F.when(k % 7 != 0, F.abs(c("s_acctbal")) * 2000).alias("equity_eur"), (2000.0 + (k % 20) * 1100).alias("mwh_constant"),
            (0.03 + (k % 4) * 0.005).alias("debt_rate"), F.lit(0.085).alias("equity_return"), (15 + k % 8).cast("int").alias("debt_tenor_years"),
        )

    def market_price(self) -> DataFrame:
        """Monthly price for 24 years: actual where known, else the last 36-month mean."""
        actual = settle(self.orders.groupBy(month_start("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 3997).alias("p")), "actual")
        level = actual.orderBy(F.desc("date")).limit(36).agg(F.avg("p")).scalar()
        spine = actual.agg(F.min("date").alias("_a")).select(
            F.explode(F.sequence(F.col("_a"), F.add_months("_a", 287), F.expr("interval 1 month"))).alias("date")
        )
        return spine.join(actual, "date", "left").withColumn("_l", level).select("date", F.coalesce("p", "_l").alias("p_market"))

    def capture_series(self) -> DataFrame:
        """Monthly capture factor over all zones."""
        p, w = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity")
        return self.lineitem.groupBy(month_start("l_shipdate").alias("date")).agg((F.sum(p * w) / F.sum(w) / F.avg(p)).alias("cf_raw"))

    def curtailment_series(self) -> DataFrame:
        names = {"AFRICA": "50Hertz", "AMERICA": "TenneT", "ASIA": "Amprion", "EUROPE": "TransnetBW"}
        named = F.coalesce(*[F.when(F.col("tso") == k, F.lit(v)) for k, v in names.items()])
        return self.tso_quarter().select(F.coalesce(named, F.col("tso")).alias("tso"), "quarter", (F.col("cr") * 0.3).alias("cr_hat"))

    def strike_series(self) -> DataFrame:
        """Monthly strikes, known in the four auction months of a year only."""
        price = F.when(F.month("l_shipdate").isin(1, 4, 7, 10), F.col("l_extendedprice") / F.col("l_quantity"))
        return self.lineitem.groupBy(month_start("l_shipdate").alias("date")).agg((F.avg(price) / 41).alias("strike"))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its SQL twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        REGISTRY[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


_TYPE = "CASE {k} % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"

CTE: dict[str, str] = {
    "zone_hourly": """SELECT n_name AS zone, l_shipdate AS ts, l_extendedprice / l_quantity / 6.997::DOUBLE AS price_eur_mwh, l_quantity AS wind_mwh
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "region_orders": """SELECT r_name AS tso, n_name AS zone, o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "region_month": """SELECT tso, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) / 3997 AS price,
        sum(o_totalprice) / 997 AS wind_mwh,
        sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) + 0.5 AS capture_factor
        FROM region_orders GROUP BY ALL""",
    "tso_quarter": """SELECT *, curt_mwh / (curt_mwh + prod_mwh) AS cr, wind_mwh / load_mwh AS S FROM (
        SELECT tso, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
        coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS curt_mwh,
        coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0) AS prod_mwh,
        coalesce(sum(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), 0) AS wind_mwh,
        sum(o_totalprice) AS load_mwh FROM region_orders GROUP BY ALL)""",
    "telemetry": f"""SELECT 'S' || (user_id % 2) AS site_id, 'T' || (user_id % 10) AS turbine_id, ts, event_id, event_type,
        value * 10 / 0.997::DOUBLE - 20 AS power_kw, value / 0.997::DOUBLE % 25 AS wind_speed_ms, {_TYPE.format(k='(user_id % 10)')} AS turbine_type FROM events""",
    "curve": """SELECT * FROM (VALUES ('alpha', 0, 3.0::DOUBLE, 0.0::DOUBLE), ('alpha', 1, 5, 200), ('alpha', 2, 8, 800), ('alpha', 3, 12, 1990), ('alpha', 4, 25, 2000), ('alpha', 5, 25.5, 0),
        ('beta', 0, 2.5, 0), ('beta', 1, 4, 120), ('beta', 2, 7.3, 900), ('beta', 3, 11, 2700), ('beta', 4, 13, 3000), ('beta', 5, 24, 3000),
        ('gamma', 0, 3.5, 18), ('gamma', 1, 6, 300), ('gamma', 2, 9, 980), ('gamma', 3, 14, 1480)) AS c(turbine_type, i, v, p)""",
    "spec": """SELECT * FROM (VALUES ('alpha', 2000.0::DOUBLE, 90.0::DOUBLE, 3.0::DOUBLE), ('beta', 3000, 112, 3.5), ('gamma', 1500, 77, 3.5)) AS s(turbine_type, rated_power_kw, rotor_diameter_m, cut_in_ws)""",
    "climate": """SELECT time, lat_i, lon_i, a / 9.7::DOUBLE - 2 AS u10, b / 50 - 1 AS v10, a / 7.9::DOUBLE - 2 AS u100, b / 40 - 1 AS v100, 275 + a / 9.7::DOUBLE AS t2m,
        101325 - b * 10 AS sp, 271 + a / 19.7::DOUBLE AS d2m, 0.1 + k * 0.001::DOUBLE AS fsr, m / 10 AS zust FROM (
        SELECT date_trunc('day', ts)::TIMESTAMP AS time, CAST(user_id % 3 + 200 AS INT) AS lat_i, CAST((user_id // 3) % 3 + 40 AS INT) AS lon_i,
        avg(value) AS a, max(value) AS b, min(value) AS m, count(*) AS k FROM events GROUP BY ALL)""",
    "sites": f"""SELECT s_suppkey AS site_id, 50 + (s_suppkey % 11) * 0.05::DOUBLE AS lat, 10 + (s_suppkey % 13) * 0.05::DOUBLE AS lon,
        80.0::DOUBLE + 10 * (s_suppkey % 8) AS hub_height_m, {_TYPE.format(k='s_suppkey')} AS turbine_type FROM supplier""",
    "corners": """SELECT site_id, lat_i, lon_i, weight, count(*) OVER (PARTITION BY site_id) AS n_corners FROM (
        SELECT site_id, CAST(floor(lat / 0.25::DOUBLE) AS INT) + dy AS lat_i, CAST(floor(lon / 0.25::DOUBLE) AS INT) + dx AS lon_i,
        (CASE dy WHEN 1 THEN lat / 0.25::DOUBLE - floor(lat / 0.25::DOUBLE) ELSE 1 - (lat / 0.25::DOUBLE - floor(lat / 0.25::DOUBLE)) END)
        * (CASE dx WHEN 1 THEN lon / 0.25::DOUBLE - floor(lon / 0.25::DOUBLE) ELSE 1 - (lon / 0.25::DOUBLE - floor(lon / 0.25::DOUBLE)) END) AS weight
        FROM sites, (VALUES (0), (1)) AS y(dy), (VALUES (0), (1)) AS x(dx)) WHERE weight > 0""",
    "site_grid": "SELECT site_id, time, " + ", ".join(
        f"CASE WHEN count({v}) = max(n_corners) THEN sum(weight * {v}) END AS {v}" for v in ["u10", "v10", "u100", "v100", "t2m", "sp", "d2m", "fsr", "zust"]
    ) + " FROM climate JOIN corners USING (lat_i, lon_i) GROUP BY ALL",
    "scenarios": """SELECT s_suppkey AS scenario_id, CAST(1 + s_suppkey % 20 AS INT) AS n_turbines, CAST(s_suppkey % 3 AS INT) AS turbine_type_id,
        100.0::DOUBLE + 10 * (s_suppkey % 9) AS hub_height_m, CAST(s_suppkey % 4 AS INT) AS tso_id,
        CASE s_suppkey % 4 WHEN 0 THEN '50Hertz' WHEN 1 THEN 'TenneT' WHEN 2 THEN 'Amprion' ELSE 'TransnetBW' END AS tso,
        make_date(1996 + s_suppkey % 3, 1 + s_suppkey % 12, 1) AS cod, CAST(s_suppkey % 2 AS INT) AS eeg_on,
        CASE WHEN s_suppkey % 5 = 0 THEN 60 + s_acctbal / 997 END AS manual_eeg_strike,
        CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) * 2000 END AS equity_eur, 2000.0::DOUBLE + (s_suppkey % 20) * 1100 AS mwh_constant,
        0.03::DOUBLE + (s_suppkey % 4) * 0.005::DOUBLE AS debt_rate, 0.085::DOUBLE AS equity_return, CAST(15 + s_suppkey % 8 AS INT) AS debt_tenor_years FROM supplier""",
    "market_actual": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 3997 AS p FROM orders GROUP BY ALL",
    "market_price": """SELECT CAST(m AS DATE) AS date, coalesce(p, (SELECT avg(p) FROM (SELECT p FROM market_actual ORDER BY date DESC LIMIT 36))) AS p_market
        FROM (SELECT unnest(generate_series((SELECT min(date) FROM market_actual)::TIMESTAMP, ((SELECT min(date) FROM market_actual) + INTERVAL 287 MONTH)::TIMESTAMP, INTERVAL 1 MONTH)) AS m)
        LEFT JOIN market_actual a ON a.date = CAST(m AS DATE)""",
    "capture_series": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
        sum(l_extendedprice / l_quantity * l_quantity) / sum(l_quantity) / avg(l_extendedprice / l_quantity) AS cf_raw
        FROM lineitem GROUP BY ALL""",
    "curtailment_series": """SELECT CASE tso WHEN 'AFRICA' THEN '50Hertz' WHEN 'AMERICA' THEN 'TenneT' WHEN 'ASIA' THEN 'Amprion' WHEN 'EUROPE' THEN 'TransnetBW' ELSE tso END AS tso,
        quarter, cr * 0.3::DOUBLE AS cr_hat FROM tso_quarter""",
    "strike_series": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(CASE WHEN month(l_shipdate) IN (1, 4, 7, 10) THEN l_extendedprice / l_quantity END) / 41 AS strike
        FROM lineitem GROUP BY ALL""",
}
NEEDS = {
    "region_month": ["region_orders"], "tso_quarter": ["region_orders"], "corners": ["sites"], "site_grid": ["sites", "corners", "climate"],
    "market_price": ["market_actual"], "curtailment_series": ["region_orders", "tso_quarter"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` over the named CTEs (and what they need), then ``extra`` CTEs in order."""
    order: list[str] = []
    for n in names:
        for need in [*NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({text})" for n, text in extra.items()]
    recursive = "RECURSIVE " if any("/*rec*/" in t for t in extra.values()) else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
