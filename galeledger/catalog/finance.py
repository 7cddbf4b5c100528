"""C*: costs, revenue, cash flow and valuation over the scenario table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregate
from ..operators.timeline import month_horizon
from ..plans import costs, finance, revenue
from ..session import settle
from .aggregations import DEVELOPMENT_SQL, _costs
from .base import Tables, query, r, rounded, sql

MONTHS, YEARS = 240, 20

CAPEX = """SELECT *, n_turbines * p_mw AS park_mw, t_kw + 551 AS capex_kw, n_turbines * p_mw * 1000 * (t_kw + 551) AS capex_eur FROM (
    SELECT *, 1476.19::DOUBLE - 65.62::DOUBLE * p_mw - 1.29::DOUBLE * sfl + 3.5::DOUBLE * hub_height_m AS t_kw FROM (
    SELECT *, p_mw * 1000000 / (pi() * (rotor / 2) * (rotor / 2)) AS sfl FROM (
    SELECT *, CASE turbine_type_id WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 5.6::DOUBLE ELSE 4.2::DOUBLE END AS p_mw, CASE turbine_type_id WHEN 0 THEN 170.0::DOUBLE WHEN 1 THEN 160.0::DOUBLE ELSE 130.0::DOUBLE END AS rotor FROM scenarios)))"""
FIN = """SELECT *, CASE WHEN debt_eur > 0 THEN annual_debt_service_eur * debt_tenor_years - debt_eur ELSE 0 END AS total_interest_eur FROM (
    SELECT *, CASE WHEN debt_eur <= 0 THEN 0 ELSE debt_eur * (debt_rate * pow(1 + debt_rate, debt_tenor_years) / (pow(1 + debt_rate, debt_tenor_years) - 1)) END AS annual_debt_service_eur FROM (
    SELECT *, capex_eur * (1 - share) AS debt_eur, share * equity_return + (1 - share) * debt_rate AS wacc, coalesce(equity_eur, 0.15::DOUBLE * capex_eur) AS equity_in FROM (
    SELECT *, greatest(0, least(0.999999::DOUBLE, coalesce(equity_eur / capex_eur, 0.15::DOUBLE))) AS share FROM cap)))"""
PANEL = {
    "starts": "SELECT DISTINCT tso, cod FROM scenarios",
    "spine": f"SELECT tso, cod, CAST(cod + INTERVAL (k) MONTH AS DATE) AS date FROM starts, range({MONTHS}) AS h(k)",
    "cm": "SELECT tso, CAST(quarter + INTERVAL (k) MONTH AS DATE) AS date, avg(cr_hat) AS cr FROM curtailment_series, range(3) AS h(k) GROUP BY ALL",
    "raw": "SELECT s.*, p_market, greatest(0.5, least(1.05, cf_raw)) AS cf, cm.cr AS cr0 FROM spine s LEFT JOIN market_price USING (date) ASOF LEFT JOIN capture_series c ON c.date <= s.date LEFT JOIN cm ON cm.tso = s.tso AND cm.date = s.date",
    "panel": """SELECT r.tso, r.cod, r.date, p_market, cf, greatest(0, least(0.3, coalesce(last_value(cr0 IGNORE NULLS) OVER (PARTITION BY tso, cod ORDER BY r.date),
        first_value(cr0 IGNORE NULLS) OVER (PARTITION BY tso, cod ORDER BY r.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))) AS cr, k.strike FROM raw r ASOF LEFT JOIN (SELECT * FROM strike_series WHERE strike IS NOT NULL) k ON k.date <= r.cod""",
    "rev": """SELECT *, delivered * realised AS revenue_eur, CASE WHEN eeg_on = 1 THEN greatest(0, st - merchant) * delivered ELSE 0 END AS eeg_premium_eur FROM (
        SELECT *, CASE WHEN eeg_on = 1 THEN greatest(merchant, st) ELSE merchant END AS realised FROM (
        SELECT scenario_id, tso, cod, date, eeg_on, CAST(floor(((year(date) - year(cod)) * 12 + month(date) - month(cod)) / 12) + 1 AS INT) AS py, mwh_constant, cr, mwh_constant * (1 - cr) AS delivered, p_market, cf, p_market * cf AS merchant,
        CASE WHEN eeg_on = 1 THEN coalesce(manual_eeg_strike, strike) END AS st, CASE WHEN eeg_on = 0 THEN 'off' WHEN manual_eeg_strike IS NOT NULL THEN 'manual' ELSE 'from_series_asof' END AS strike_source
        FROM scenarios JOIN panel USING (tso, cod)))""",
}
NAMES = ["scenarios", "market_price", "capture_series", "curtailment_series", "strike_series"]
FLOWS = {
    "cap": CAPEX, "fin": FIN, **PANEL, "ry": "SELECT scenario_id, py, sum(revenue_eur) AS rv FROM rev GROUP BY ALL",
    "cy": """SELECT scenario_id, py AS t, coalesce(rv, 0) - park_mw * 1000 * CASE WHEN py <= 10 THEN 53 ELSE 55 END - CASE WHEN py <= debt_tenor_years THEN annual_debt_service_eur ELSE 0 END
        + CASE WHEN py = 20 THEN 0.3::DOUBLE * capex_eur ELSE 0 END AS cf FROM ry JOIN fin USING (scenario_id) UNION ALL SELECT scenario_id, 0, -equity_in FROM fin WHERE scenario_id IN (SELECT scenario_id FROM ry)""",
    "fl": "SELECT scenario_id, list(cf ORDER BY t) AS cfs FROM cy GROUP BY scenario_id",
}
NEWTON = """/*rec*/ SELECT scenario_id, cfs, 0.08::DOUBLE AS r, 0 AS i, CASE WHEN list_min(cfs) >= 0 OR list_max(cfs) <= 0 THEN 'no sign change' ELSE 'run' END AS s FROM fl UNION ALL
    SELECT scenario_id, cfs, CASE WHEN abs(v) < 1e-6 OR abs(d) < 1e-12 THEN r ELSE r - v / d END, i + 1,
    CASE WHEN abs(v) < 1e-6 THEN 'ok' WHEN abs(d) < 1e-12 THEN 'no convergence' WHEN r - v / d <= -0.99 OR r - v / d >= 5 THEN 'out of bounds' WHEN abs(v / d) < 1e-9 THEN 'ok' ELSE 'run' END
    FROM (SELECT *, list_sum(list_transform(range(len(cfs)), lambda t: cfs[t + 1] / pow(1 + r, t))) AS v, list_sum(list_transform(range(len(cfs)), lambda t: -t * cfs[t + 1] / pow(1 + r, t + 1))) AS d FROM nw WHERE s = 'run' AND i < 200)"""


def panel_of(t: Tables) -> DataFrame:
    return settle(revenue.driver_panel(t.scenarios(), t.market_price(), t.capture_series(), t.curtailment_series(), t.strike_series(), MONTHS), "panel")


def revenue_of(t: Tables) -> DataFrame:
    return revenue.monthly_revenue(t.scenarios(), panel_of(t), carry=["tso"])


def flows_of(t: Tables) -> DataFrame:
    return finance.cash_flows(finance.financed(t.scenarios()), revenue_of(t), years=YEARS)


@query("c1_capex", sql("SELECT scenario_id, round(park_mw, 6) AS park_mw, round(sfl, 6) AS sfl, round(t_kw, 6) AS turbine_kw, round(capex_kw, 6) AS capex_kw, round(capex_eur, 2) AS capex_eur FROM cap", "scenarios", cap=CAPEX))
def c1(t: Tables) -> DataFrame:
    out = costs.with_capex(t.scenarios())
    return out.select("scenario_id", r("park_mw").alias("park_mw"), r("sfl").alias("sfl"), r("turbine_capex_eur_per_kw").alias("turbine_kw"), r("capex_eur_per_kw").alias("capex_kw"), r("capex_eur", 2).alias("capex_eur"))


@query("c2_opex", sql("SELECT scenario_id, round(park_mw * 1000 / 12 * (53 * 120 + 55 * 110), 2) AS total_opex_eur, round(park_mw * 1000 * 53, 2) AS first_year FROM cap", "scenarios", cap=CAPEX))
def c2(t: Tables) -> DataFrame:
    rows = costs.opex_by_year(costs.with_capex(t.scenarios()), ["scenario_id"], 230)
    return rows.groupBy("scenario_id").agg(r(F.sum("annual_opex_eur"), 2).alias("total_opex_eur"), r(F.max(F.when(F.col("project_year") == 1, F.col("annual_opex_eur"))), 2).alias("first_year"))


@query("c3_equity_share", sql("SELECT scenario_id, round(share, 6) AS share, round(capex_eur * share, 2) AS equity, round(debt_eur, 2) AS debt FROM fin", "scenarios", cap=CAPEX, fin=FIN))
def c3(t: Tables) -> DataFrame:
    out = finance.financed(t.scenarios())
    return out.select("scenario_id", r("equity_share_used").alias("share"), r("equity_eur_final", 2).alias("equity"), r("debt_eur", 2).alias("debt"))


@query("c4_annuity_wacc", sql("SELECT scenario_id, round(annual_debt_service_eur, 2) AS service, round(total_interest_eur, 2) AS interest, round(wacc, 8) AS wacc FROM fin", "scenarios", cap=CAPEX, fin=FIN))
def c4(t: Tables) -> DataFrame:
    out = finance.financed(t.scenarios())
    return out.select("scenario_id", r("annual_debt_service_eur", 2).alias("service"), r("total_interest_eur", 2).alias("interest"), r("wacc", 8).alias("wacc"))


@query("c5_debt_schedule", sql("SELECT scenario_id, CAST(y AS INT) AS project_year, round(CASE WHEN y <= debt_tenor_years THEN annual_debt_service_eur ELSE 0 END, 2) AS debt_service FROM fin, range(1, 21) AS h(y)", "scenarios", cap=CAPEX, fin=FIN))
def c5(t: Tables) -> DataFrame:
    rows = finance.financed(t.scenarios()).withColumn("project_year", F.explode(F.sequence(F.lit(1), F.lit(YEARS))))
    return rows.select("scenario_id", "project_year", r(costs.debt_service("project_year"), 2).alias("debt_service"))


@query("c6_driver_panel", sql("SELECT tso, cod, date, round(p_market, 6) AS p_market, round(cf, 6) AS cf, round(cr, 6) AS cr, round(strike, 6) AS strike FROM panel", *NAMES, **{k: v for k, v in PANEL.items() if k != "rev"}))
def c6a(t: Tables) -> DataFrame:
    return rounded(panel_of(t).withColumnRenamed("strike_series", "strike"), ["p_market", "cf", "cr", "strike"])


@query("c6_monthly_revenue", sql("""SELECT scenario_id, date, mwh_constant AS mwh_gross_park, round(cr, 6) AS cr, round(delivered, 4) AS mwh_delivered, round(p_market, 6) AS p_market, round(cf, 6) AS cf, round(merchant, 6) AS p_wind_merchant, eeg_on,
    round(st, 6) AS strike_cod_fixed, round(realised, 6) AS p_wind_realised, round(revenue_eur, 2) AS revenue_eur, round(eeg_premium_eur, 2) AS eeg_premium_eur, strike_source FROM rev""", *NAMES, **PANEL))
def c6(t: Tables) -> DataFrame:
    out = revenue_of(t).drop("tso", "project_month", "project_year")
    out = rounded(out, ["cr", "p_market", "cf", "p_wind_merchant", "strike_cod_fixed", "p_wind_realised"])
    return rounded(rounded(out, ["mwh_delivered"], 4), ["revenue_eur", "eeg_premium_eur"], 2)


@query("c6_rejected_scenarios", sql("""SELECT scenario_id, 'production month missing' AS reject_reason, min(date) AS first_missing FROM (SELECT scenario_id, CAST(cod + INTERVAL (k) MONTH AS DATE) AS date FROM scenarios, range(240) AS h(k)) s
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = scenario_id AND date_trunc('month', l_shipdate) = date) GROUP BY ALL""", "scenarios"))
def c6c(t: Tables) -> DataFrame:
    production = t.lineitem.select(F.col("l_suppkey").alias("scenario_id"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date"), F.col("l_quantity").alias("mwh"))
    production = production.groupBy("scenario_id", "date").agg(F.sum("mwh").alias("mwh"))
    panel = settle(revenue.driver_panel(t.scenarios(), t.market_price(), t.capture_series(), t.curtailment_series(), t.strike_series(), MONTHS), "panel")
    return revenue.rejected_scenarios(t.scenarios(), production, panel, months=MONTHS)


_MWH = "mwh_constant * (0.8::DOUBLE + 0.02::DOUBLE * month(date))"


@query("c6_revenue_from_production", sql("""SELECT scenario_id, date, round(mwh, 4) AS mwh_gross_park, round(delivered, 4) AS mwh_delivered, round(revenue_eur, 2) AS revenue_eur, round(eeg_premium_eur, 2) AS eeg_premium_eur FROM rev""",
    *NAMES, **{**PANEL, "rev": PANEL["rev"].replace("mwh_constant, cr, mwh_constant * (1 - cr)", f"{_MWH} AS mwh, cr, {_MWH} * (1 - cr)")}))
def c6d(t: Tables) -> DataFrame:
    months = month_horizon(t.scenarios().select("scenario_id", "cod", "mwh_constant"), "cod", MONTHS, "date")
    production = months.select("scenario_id", "date", (F.col("mwh_constant") * (0.8 + 0.02 * F.month("date"))).alias("mwh"))
    out = revenue.monthly_revenue(t.scenarios().drop("mwh_constant"), panel_of(t), production)
    return rounded(rounded(out.select("scenario_id", "date", "mwh_gross_park", "mwh_delivered", "revenue_eur", "eeg_premium_eur"), ["mwh_gross_park", "mwh_delivered"], 4), ["revenue_eur", "eeg_premium_eur"], 2)


@query("c7_cash_flow", sql("SELECT scenario_id, CAST(t AS INT) AS t, round(cf, 2) AS cf FROM cy", *NAMES, **FLOWS))
def c7(t: Tables) -> DataFrame:
    return flows_of(t).select("scenario_id", F.posexplode("cash_flow").alias("t", "cf")).withColumn("cf", r("cf", 2))


@query("c8_npv", sql("SELECT scenario_id, round(sum(cf / pow(1 + wacc, t)), 2) AS npv_eur FROM cy JOIN fin USING (scenario_id) GROUP BY ALL", *NAMES, **FLOWS))
def c8(t: Tables) -> DataFrame:
    return flows_of(t).select("scenario_id", r(finance.npv("cash_flow", "wacc"), 2).alias("npv_eur"))


NPV_AT = "list_sum(list_transform(range(len(cfs)), lambda t: cfs[t + 1] / pow(1 + {r}, t)))"
FALLBACK = {
    # With more than one change of sign the grid decides, whatever Newton found.
    "last": "SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY i DESC) = 1",
    "res": """SELECT * REPLACE (CASE WHEN s = 'ok' AND list_sum(list_transform(range(1, len(z)), lambda i: CASE WHEN sign(z[i]) <> sign(z[i + 1]) THEN 1 ELSE 0 END)) > 1 THEN 'several roots' ELSE s END AS s)
        FROM (SELECT *, list_filter(cfs, lambda c: c <> 0) AS z FROM last)""",
    "gr": f"SELECT *, {NPV_AT.format(r='rt')} AS v FROM (SELECT scenario_id, cfs, k, pow(600.0::DOUBLE, k / 128) * 0.01::DOUBLE - 1 AS rt FROM res, range(129) AS h(k) WHERE s NOT IN ('ok', 'no sign change'))",
    "br": """SELECT scenario_id, cfs, lo, hi, vlo FROM (SELECT *, lag(rt) OVER w AS lo, rt AS hi, lag(v) OVER w AS vlo FROM gr WINDOW w AS (PARTITION BY scenario_id ORDER BY k))
        WHERE sign(vlo) * sign(v) <= 0 QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY least(abs(lo), abs(hi))) = 1""",
    "bi": f"""/*rec*/ SELECT *, 0 AS j FROM br UNION ALL SELECT scenario_id, cfs, CASE WHEN same THEN mid ELSE lo END, CASE WHEN same THEN hi ELSE mid END, vlo, j + 1
        FROM (SELECT *, sign({NPV_AT.format(r='mid')}) = sign(vlo) AS same FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE j < 60))""",
}


@query("c9_irr", sql("""SELECT scenario_id, round(CASE WHEN s = 'ok' THEN r ELSE (lo + hi) / 2 END, 6) AS irr, CASE WHEN s IN ('ok', 'no sign change') THEN s WHEN lo IS NULL THEN 'no root in bounds' ELSE 'ok' END AS irr_reason
    FROM res LEFT JOIN (SELECT scenario_id, lo, hi FROM bi WHERE j = 60) USING (scenario_id)""", *NAMES, **FLOWS, nw=NEWTON, **FALLBACK))
def c9(t: Tables) -> DataFrame:
    return finance.valued(flows_of(t)).select("scenario_id", r("irr").alias("irr"), "irr_reason")


@query("c10_yearly_table", sql("""SELECT scenario_id, y.py AS year, round(mwh, 2) AS mwh_gross, round(mp, 6) AS market_price_electricity, round(cf, 6) AS cf, round(cr, 6) AS cr, round(ox, 2) AS opex, round(ds, 2) AS debt_service, round(rv - ox - ds, 2) AS profit FROM (
    SELECT scenario_id, py, sum(delivered) AS mwh, sum(p_market * delivered) / sum(delivered) AS mp, avg(cf) AS cf, avg(cr) AS cr, sum(revenue_eur) AS rv FROM rev GROUP BY ALL) y JOIN (
    SELECT scenario_id, py, park_mw * 1000 * CASE WHEN py <= 10 THEN 53 ELSE 55 END AS ox, CASE WHEN py <= debt_tenor_years THEN annual_debt_service_eur ELSE 0 END AS ds FROM fin, range(1, 21) AS h(py)) c USING (scenario_id, py)""", *NAMES, cap=CAPEX, fin=FIN, **PANEL))
def c10(t: Tables) -> DataFrame:
    out = finance.yearly_table(finance.financed(t.scenarios()), revenue_of(t))
    return rounded(rounded(out, ["market_price_electricity", "cf", "cr"]), ["mwh_gross", "opex", "debt_service", "profit"], 2)


@query("c11_development_costs", DEVELOPMENT_SQL)
def c11(t: Tables) -> DataFrame:
    return rounded(aggregate.development_costs(_costs(t)), ["mean_eur_per_kw"], 4)


@query("c_request_table", sql("""SELECT s.scenario_id, CASE WHEN s.scenario_id % 10 = 9 THEN NULL ELSE npv_eur END AS npv_eur, round(capex_eur, 2) AS capex_eur, CASE WHEN s.scenario_id % 10 = 9 THEN 'operator or start missing' ELSE '' END AS reasons
    FROM fin s LEFT JOIN (SELECT scenario_id, round(sum(cf / pow(1 + wacc, t)), 2) AS npv_eur FROM cy JOIN fin USING (scenario_id) GROUP BY ALL) v USING (scenario_id)""", *NAMES, **FLOWS))
def c_requests(t: Tables) -> DataFrame:
    """All scenarios in one call; every tenth names no operator and comes back with its reason."""
    from ..plans.requests import answered

    asked = t.scenarios().withColumn("tso", F.when(F.col("scenario_id") % 10 != 9, F.col("tso")))
    out = answered(asked, t.market_price(), t.capture_series(), t.curtailment_series(), t.strike_series(), months=MONTHS)
    return out.select("scenario_id", r("npv_eur", 2).alias("npv_eur"), r("capex_eur", 2).alias("capex_eur"), F.concat_ws(";", "reject_reasons").alias("reasons"))
