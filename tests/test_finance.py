"""Costs, revenue and valuation: identities, guards and edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from galeledger.operators import checks
from galeledger.operators.timeline import month_horizon
from galeledger.plans import costs, finance, revenue
from galeledger.session import settle
from galeledger.sources import sinks

SCHEMA = """scenario_id long, tso string, cod date, eeg_on int, manual_eeg_strike double, mwh_constant double, n_turbines int, turbine_type_id int,
    hub_height_m double, equity_eur double, debt_rate double, equity_return double, debt_tenor_years int"""
COD = dt.date(2026, 1, 1)


def scenario(i, **kw):
    base = dict(scenario_id=i, tso="50Hertz", cod=COD, eeg_on=1, manual_eeg_strike=None, mwh_constant=12000.0, n_turbines=12, turbine_type_id=1,
                hub_height_m=160.0, equity_eur=20e6, debt_rate=0.045, equity_return=0.085, debt_tenor_years=18)
    return tuple({**base, **kw}[c.split()[0]] for c in SCHEMA.replace("\n", " ").split(", "))


def month(i):
    return dt.date(2024 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def drivers(spark):
    market = spark.createDataFrame([(month(i), 50.0 + i % 12) for i in range(300)], "date date, p_market double")
    cf = spark.createDataFrame([(month(i), 0.9 if i < 60 else 2.0) for i in range(0, 300, 5)], "date date, cf_raw double")
    cr = spark.createDataFrame([("50Hertz", month(36 + 3 * i), 0.02) for i in range(10)] + [("50Hertz", month(36), 0.04)], "tso string, quarter date, cr_hat double")
    strikes = spark.createDataFrame([(dt.date(2025, 11, 1), 61.0), (dt.date(2026, 2, 1), 99.0)], "date date, strike double")
    return market, cf, cr, strikes


@pytest.fixture(scope="module")
def scenarios(spark):
    return spark.createDataFrame([
        scenario(1), scenario(2, eeg_on=0), scenario(3, manual_eeg_strike=80.0, cod=dt.date(2026, 1, 1)), scenario(4, equity_eur=1e12), scenario(5, debt_rate=0.0, debt_tenor_years=30), scenario(6, equity_eur=None),
    ], SCHEMA)


@pytest.fixture(scope="module")
def monthly(scenarios, drivers):
    return revenue.monthly_revenue(scenarios, revenue.driver_panel(scenarios, *drivers), carry=["tso"]).cache()


def test_horizon_clip_fill_and_fixed_strike(monthly):
    assert monthly.groupBy("scenario_id").count().where("count <> 240").count() == 0
    m = {r["date"]: r for r in monthly.where("scenario_id = 1").collect()}
    assert len({r["strike_cod_fixed"] for r in m.values()}) == 1 and m[COD]["strike_cod_fixed"] == 61.0 and m[COD]["strike_source"] == "from_series_asof"
    # First known curtailment is 2027Q1 (two values, averaged): filled backward before, forward after the last.
    assert np.isclose(m[COD]["cr"], 0.03) and np.isclose(m[dt.date(2027, 1, 1)]["cr"], 0.03) and np.isclose(m[dt.date(2045, 12, 1)]["cr"], 0.02)
    assert m[COD]["cf"] == 0.9 and m[dt.date(2045, 1, 1)]["cf"] == 1.05


def test_floor_and_premium(monthly):
    for r in monthly.collect():
        floor = r["strike_cod_fixed"] if r["eeg_on"] else None
        assert r["p_wind_realised"] == (max(r["p_wind_merchant"], floor) if floor is not None else r["p_wind_merchant"])
        assert np.isclose(r["revenue_eur"], r["mwh_delivered"] * r["p_wind_merchant"] + r["eeg_premium_eur"])
    src = dict(monthly.select("scenario_id", "strike_source").distinct().collect())
    assert src[2] == "off" and src[3] == "manual"


def test_cash_flow_npv_irr(scenarios, monthly):
    fin = finance.financed(scenarios)
    got = {r["scenario_id"]: r for r in finance.valued(finance.cash_flows(fin, monthly)).collect()}
    yearly = finance.yearly_table(fin, monthly)
    profit = {}
    for r in yearly.collect():
        profit.setdefault(r["scenario_id"], {})[r["year"]] = r["profit"]
    for i, r in got.items():
        flow = np.array(r["cash_flow"])
        want = np.array([-r["equity_in_eur"]] + [profit[i][y] for y in range(1, 21)])
        want[-1] += 0.3 * r["capex_eur"]
        assert np.allclose(flow, want)
        t = np.arange(21)
        assert np.isclose(r["npv_eur"], (flow / (1 + r["wacc"]) ** t).sum())
        if r["irr_reason"] == "ok":
            assert abs((flow / (1 + r["irr"]) ** t).sum()) < 1e-9 * np.abs(flow).sum()
    assert got[1]["irr_reason"] == "ok"
    total = monthly.groupBy("scenario_id").agg(F.sum("revenue_eur")).collect()
    summed = yearly.withColumn("rev", F.col("profit") + F.col("opex") + F.col("debt_service")).groupBy("scenario_id").agg(F.sum("rev")).collect()
    assert np.allclose([v for _, v in sorted(total)], [v for _, v in sorted(summed)])


def test_irr_edge_cases(spark):
    flows = [[-100.0, 110.0], [1.0, 2.0], [-1.0, -2.0], [-100.0] + [20.0] * 10, [-1.0, 1000.0], [0.0, 0.0],
             [-100.0] + [-5.0] * 9 + [100 * 0.95**10 + 5 * sum(0.95**k for k in range(1, 10))], [-100.0, 70.0]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flows)], "i int, f array<double>").select("i", finance.irr("f").alias("x")).select("i", "x.*")
    got = {r["i"]: (r["rate"], r["reason"]) for r in df.collect()}
    assert np.isclose(got[0][0], 0.10) and got[1] == (None, "no sign change") and got[2] == (None, "no sign change") and got[5] == (None, "no sign change")
    assert np.isclose(got[3][0], 0.150984, atol=1e-5) and got[4] == (None, "no root in bounds")
    # Loss-making: the root is negative and Newton from 8 % would run away.
    assert np.isclose(got[6][0], -0.05, atol=1e-6) and np.isclose(got[7][0], -0.3, atol=1e-6)


def test_financing_edges(spark, scenarios):
    got = {r["scenario_id"]: r for r in finance.financed(scenarios).collect()}
    assert got[4]["equity_share_used"] == 0.999999 and got[4]["debt_eur"] > 0
    assert np.isclose(got[5]["annual_debt_service_eur"], got[5]["debt_eur"] / 30) and np.isclose(got[5]["total_interest_eur"], 0, atol=1e-3)
    assert np.isclose(got[6]["equity_share_used"], 0.15) and np.isclose(got[6]["equity_in_eur"], 0.15 * got[6]["capex_eur"])
    r, n, d = 0.045, 18, got[1]["debt_eur"]
    assert np.isclose(got[1]["annual_debt_service_eur"], d * r * (1 + r) ** n / ((1 + r) ** n - 1))
    sfl = 5.6e6 / (np.pi * 80 ** 2)
    assert np.isclose(got[1]["capex_eur"], 12 * 5600 * (1476.19 - 65.62 * 5.6 - 1.29 * sfl + 3.5 * 160 + 551))
    late = finance.financed(scenarios).where("scenario_id = 1").select(costs.debt_service(F.lit(18)), costs.debt_service(F.lit(19))).first()
    assert late[0] > 0 and late[1] == 0


def test_opex_partial_year(spark):
    df = spark.createDataFrame([(1, 10.0)], "k int, park_mw double")
    got = rows(costs.opex_by_year(df, ["k"], 126), "project_year")
    assert [r[3] for r in got] == [53.0] * 10 + [55.0] and got[-1][4] == 6 and np.isclose(got[-1][2], 10_000 * 55 / 2)
    assert np.isclose(df.select(costs.opex_total("park_mw", 126)).first()[0], sum(r[2] for r in got))


def test_rejects(spark, scenarios, drivers):
    market, cf, cr, strikes = drivers
    bad = scenarios.unionByName(spark.createDataFrame([scenario(7, tso="TenneT"), scenario(8, cod=dt.date(2025, 1, 1))], SCHEMA))
    panel = revenue.driver_panel(bad, market.where("date <> date'2030-05-01'"), cf, cr, strikes)
    production = month_horizon(bad.select("scenario_id", "cod"), "cod", 240, "date").withColumn("mwh", F.lit(1.0)).where("NOT (scenario_id = 1 AND date = date'2027-03-01')")
    got = {}
    for r in revenue.rejected_scenarios(bad, production, panel).collect():
        got.setdefault(r["reject_reason"], {})[r["scenario_id"]] = r["first_missing"]
    assert set(got["market price missing"].values()) == {dt.date(2030, 5, 1)}
    assert set(got["no curtailment rate for operator"]) == {7} and set(got["no strike at or before start"]) == {8}
    assert got["production month missing"] == {1: dt.date(2027, 3, 1)}


def test_scenario_rules(spark, scenarios):
    bad = scenarios.withColumn("tso_id", F.lit(0)).withColumn("n_turbines", F.when(F.col("scenario_id") == 2, 0).otherwise(F.col("n_turbines")))
    good, rejected = checks.split_valid(bad, checks.scenario_rules())
    assert {r[0]: r[1] for r in rejected.select("scenario_id", "reject_reason").collect()} == {2: "n_turbines", 6: "equity_eur"} and good.count() == 4


def test_summary_and_json(monthly):
    got = {r["metric"]: r["value"] for r in sinks.revenue_summary(monthly.where("scenario_id = 1"), ["scenario_id"]).collect()}
    assert got["TSO"] == "50Hertz" and got["EEG_ON"] == "1" and got["COD"] == "2026-01-01" and got["EEG_strike_fixed_eur_mwh"] == "61.0000" and len(got) == 6
    text = sinks.json_rows(monthly.where("scenario_id = 2").limit(1).select("date", F.lit(float("inf")).alias("x"))).first()[0]
    assert text == '{"date":"2026-01-01","x":null}'


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_sorts_no_months(spark):
    """Sums of months are hashed; what is sorted is what is left of a key. Several operators and unknown ones count together."""
    rows = [(1, "a", 1, COD, 50.0, 10.0), (1, "b", 0, dt.date(2025, 12, 1), None, 30.0), (1, None, 0, dt.date(2026, 5, 1), 70.0, None), (2, None, 0, COD, None, None), (None, "c", 1, COD, 1.0, 2.0)]
    many = spark.createDataFrame(rows, "scenario_id long, tso string, eeg_on int, date date, strike_cod_fixed double, revenue_eur double")
    out = sinks.revenue_summary(many, ["scenario_id"])
    got = {}
    for r in out.collect():
        got.setdefault(r["scenario_id"], []).append(r["value"])
    assert got == {1: ["b", "1", "2025-12-01", "70.0000", "40.00", "160.00"], 2: [None, "0", "2026-01-01", None, None, None], None: ["c", "1", "2026-01-01", "1.0000", "2.00", "24.00"]}
    below = plan_of(out).rsplit("HashAggregate", 1)
    assert len(below) == 2 and "Sort" not in below[1]


def test_production_is_never_broadcast(spark, scenarios, drivers):
    """The planner takes exploded months for as small as their scenarios."""
    scenarios = settle(scenarios)  # a file, so that the planner knows its size
    panel = settle(revenue.driver_panel(scenarios, *drivers))
    production = month_horizon(scenarios.select("scenario_id", "cod"), "cod", 240, "date").select("scenario_id", "date", F.lit(7.0).alias("mwh"))
    alone = scenarios.select("scenario_id", "tso", "cod", "eeg_on", "manual_eeg_strike")
    out = revenue.monthly_revenue(alone, panel, production)
    assert out.count() == 6 * 240
    assert any("SortMergeJoin" in line and "scenario_id" in line for line in plan_of(out).splitlines())


def test_partition_count_does_not_matter(scenarios, drivers):
    one = revenue.monthly_revenue(scenarios.repartition(1), revenue.driver_panel(scenarios, *drivers))
    many = revenue.monthly_revenue(scenarios.repartition(7), revenue.driver_panel(scenarios, *drivers))
    assert one.exceptAll(many).count() == 0


def test_missing_months_of_revenue_leave_no_cash_flow(scenarios, monthly):
    from pyspark.sql import functions as F

    fin = finance.financed(scenarios)
    ids = sorted(r[0] for r in fin.select("scenario_id").collect())
    full, part, none = ids[0], ids[1], ids[2]
    cut = monthly.where((F.col("scenario_id") == full) | ((F.col("scenario_id") == part) & ~((F.col("project_year") == 7) & (F.month("date") == 3))))
    got = {r["scenario_id"]: r for r in finance.valued(finance.cash_flows(fin, cut)).collect()}
    assert sorted(got) == ids and len(got[full]["cash_flow"]) == 21 and got[full]["flow_reason"] is None
    assert got[part]["cash_flow"] is None and got[part]["flow_reason"] == "revenue is incomplete in project year 7" and got[part]["npv_eur"] is None
    assert got[none]["cash_flow"] is None and got[none]["flow_reason"] == "no revenue" and got[none]["irr"] is None
