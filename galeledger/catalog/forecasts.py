"""F*: forecasts, fan-outs and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregate, forecast, learn, simulate
from ..plans import energy, market
from ..sources.catalogue import WIND_SCENARIOS
from .aggregations import REPRESENTATIVE, SIMS, simulated
from .base import GRID_STEP, Tables, query, r, rounded, sql
from .models import ANCHOR, CF_FIT, FEATS, MONTHS_FROM, PRICE_FIT, ml_rows, price_model, tree_settings

N = 240
LAST = "SELECT tso, max(month) AS month, arg_max(z, month) AS z FROM zz GROUP BY tso"
PRICE_PATH = """/*rec*/ SELECT tso, 0 AS k, month, z FROM lst UNION ALL
    SELECT p.tso, k + 1, CAST(p.month + INTERVAL 1 MONTH AS DATE), b_zl * p.z + a FROM path p JOIN f_b USING (tso) JOIN f_a ON f_a.tso = p.tso AND f_a.s = month(CAST(p.month + INTERVAL 1 MONTH AS DATE)) WHERE k < {n}"""
PRICE_FC = {**PRICE_FIT, "lst": LAST, "path": PRICE_PATH.format(n=N)}
MU = f"(10 + {MONTHS_FROM} / 12 * ln(1.01::DOUBLE))"


def _anchor():
    return F.lit(ANCHOR).cast("date")


def price_forecast(t: Tables) -> DataFrame:
    return forecast.forecast_price(price_model(t), ["tso"], _anchor(), N)


@query("f1_drift", sql(f"SELECT tso, month, round({MU} + 0.15, 6) AS mu FROM region_month", "region_month"))
def f1(t: Tables) -> DataFrame:
    return t.region_month().select("tso", "month", r(forecast.drift("month", _anchor(), 10.0, 0.01, 0.15)).alias("mu"))


@query("f2_price_path", sql(f"SELECT tso, month, round({MU}, 6) AS mu_log, round({MU} + z, 6) AS log_level, round(exp({MU} + z) - 200, 4) AS price_forecast FROM path WHERE k > 0", "region_month", **PRICE_FC))
def f2(t: Tables) -> DataFrame:
    return rounded(rounded(price_forecast(t), ["mu_log", "log_level"]), ["price_forecast"], 4)


_G = "(VALUES ('low', 0.005::DOUBLE), ('base', 0.015::DOUBLE), ('high', 0.03::DOUBLE)) AS g(scenario, growth)"
CF_FC = {
    **CF_FIT, "ref": "SELECT tso, month(month) AS s, avg(wind_mwh) AS w FROM region_month WHERE month BETWEEN '1997-01-01' AND '2000-12-01' GROUP BY ALL", "lst": LAST,
    "path": f"""/*rec*/ SELECT tso, scenario, growth, 0 AS k, month, z, 0.0::DOUBLE AS w FROM lst, {_G} UNION ALL
    SELECT tso, scenario, growth, k + 1, nm, greatest(0, least(0.98, b_zl)) * z + a + b_lw * ln(greatest(nw, 1)), nw FROM (
      SELECT p.tso, scenario, growth, k, z, nm, ref.w * pow(1 + growth, ((year(nm) - 2000) * 12 + month(nm) - 12) / 12) AS nw
      FROM (SELECT *, CAST(month + INTERVAL 1 MONTH AS DATE) AS nm FROM path) p JOIN ref ON ref.tso = p.tso AND ref.s = month(nm)) q
    JOIN f_b USING (tso) JOIN f_a ON f_a.tso = q.tso AND f_a.s = month(nm) WHERE k < {N}""",
}


def capture_forecast(t: Tables) -> DataFrame:
    hist = t.region_month()
    season = aggregate.seasonal_profile(hist.where("month BETWEEN date'1997-01-01' AND date'2000-12-01'"), ["tso"], F.month("month"), "wind_mwh")
    return forecast.forecast_capture(forecast.fit_capture_model(hist, ["tso"]), season, ["tso"], F.lit("2000-12-01").cast("date"), WIND_SCENARIOS, N)


@query("f2_capture_path", sql("SELECT tso, scenario, month, round(w, 4) AS wind_mwh, round(greatest(0.55, least(1.15, exp(z))), 6) AS capture_factor FROM path WHERE k > 0", "region_month", **CF_FC))
def f2b(t: Tables) -> DataFrame:
    return rounded(rounded(capture_forecast(t), ["capture_factor"]), ["wind_mwh"], 4)


@query("f3_actual_then_forecast", sql(f"""SELECT tso, month, round(coalesce(m.price, f.price), 4) AS price FROM region_month m
    FULL JOIN (SELECT tso, month, exp({MU} + z) - 200 AS price FROM path WHERE k > 0) f USING (tso, month)""", "region_month", **PRICE_FC))
def f3(t: Tables) -> DataFrame:
    actual = t.region_month().select("tso", "month", F.col("price").alias("a"))
    both = actual.join(price_forecast(t).select("tso", "month", F.col("price_forecast").alias("f")), ["tso", "month"], "full_outer")
    return both.select("tso", "month", r(F.coalesce("a", "f"), 4).alias("price"))


_PROJ = """SELECT l.tso, CAST(q AS DATE) AS quarter, lvl * coalesce(f, 1) * pow(1 + {g}, (year(q) * 4 + quarter(q) - mx) / 4) AS {v} FROM
    (SELECT tso, avg({v}) AS lvl FROM (SELECT * FROM tso_quarter QUALIFY row_number() OVER (PARTITION BY tso ORDER BY quarter DESC) <= 8) GROUP BY tso) l
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2046-10-01', INTERVAL 3 MONTH)) AS q) h CROSS JOIN (SELECT max(year(quarter) * 4 + quarter(quarter)) AS mx FROM tso_quarter) x
    LEFT JOIN (SELECT tso, s, m / avg(m) OVER (PARTITION BY tso) AS f FROM (SELECT tso, quarter(quarter) AS s, avg({v}) AS m FROM tso_quarter GROUP BY ALL)) p ON p.tso = l.tso AND p.s = quarter(q)"""


def _span():
    return F.lit("2000-01-01").cast("date"), F.lit("2046-10-01").cast("date")


@query("f4_seasonal_growth", sql("SELECT tso, quarter, round(wind_mwh, 2) AS wind_mwh FROM p", "tso_quarter", p=_PROJ.format(g="0.01::DOUBLE", v="wind_mwh")))
def f4(t: Tables) -> DataFrame:
    return rounded(forecast.project_quarters(t.tso_quarter(), ["tso"], "wind_mwh", 0.01, *_span()), ["wind_mwh"], 2)


@query("f5_scenario_columns", sql("SELECT tso, month, " + ", ".join(f"round(max(CASE WHEN scenario = '{s}' THEN greatest(0.55, least(1.15, exp(z))) END), 6) AS {s}" for s in WIND_SCENARIOS) + " FROM path WHERE k > 0 GROUP BY ALL", "region_month", **CF_FC))
def f5(t: Tables) -> DataFrame:
    wide = capture_forecast(t).groupBy("tso", "month").pivot("scenario", list(WIND_SCENARIOS)).agg(F.first("capture_factor"))
    return rounded(wide, list(WIND_SCENARIOS))


_YEARS = "((year(month) - 1998) * 12 + month(month) - 6) / 12"
MARK = f"CASE WHEN {_YEARS} > 0 THEN 1.02::DOUBLE + 0.13::DOUBLE * exp(-ln(2) / 12 * {_YEARS}) ELSE 1.15 END"


@query("f6_markup_decay", sql(f"SELECT tso, month, round({MARK}, 6) AS markup FROM region_month", "region_month"))
def f6(t: Tables) -> DataFrame:
    return t.region_month().select("tso", "month", r(forecast.markup("month", F.lit("1998-06-01").cast("date"), 1.15)).alias("markup"))


@query("f6_markup_from_overlap", sql("""SELECT tso, round(avg(x), 6) AS m0, max(month) AS anchor FROM (SELECT tso, month, strike / price AS x FROM region_month JOIN strike_series ON date = month WHERE strike IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY tso ORDER BY month DESC) <= 24) GROUP BY tso""", "region_month", "strike_series"))
def f6b(t: Tables) -> DataFrame:
    prices = t.region_month().select("tso", F.col("month").alias("date"), "price")
    rows = prices.join(t.strike_series(), "date", "left")
    return rounded(market.markup_from_overlap(rows.select("tso", "date", "price"), rows.where("strike IS NOT NULL").select("tso", "date", "strike"), ["tso"]), ["m0"])


STRIKES = {
    "au": "SELECT tso, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / 2999 AS strike FROM region_orders GROUP BY ALL HAVING strike IS NOT NULL",
    "an": "SELECT tso, max(date) AS anchor FROM au GROUP BY tso",
    "fu": """SELECT tso, month AS date, price, CASE WHEN y > 0 THEN 1.02::DOUBLE + 0.13::DOUBLE * exp(-ln(2) / 12 * y) ELSE 1.15 END AS mk FROM (
        SELECT r.tso, month, price, ((year(month) - year(anchor)) * 12 + month(month) - month(anchor)) / 12 AS y FROM region_month r JOIN an USING (tso))""",
}


@query("f7_strike_path", sql("""SELECT tso, date, NULL::DOUBLE AS market_price, NULL::DOUBLE AS markup_path, round(strike, 4) AS eeg_strike_used FROM au
    UNION ALL SELECT tso, date, round(price, 4), round(mk, 6), round(mk * price, 4) FROM fu""", "region_month", **STRIKES))
def f7(t: Tables) -> DataFrame:
    strike = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 2999)
    auctions = market.auction_months(t.region_orders().select("tso", F.col("o_orderdate").cast("date").alias("d"), strike.alias("s")), ["tso"], "d", "s")
    prices = t.region_month().select("tso", F.col("month").alias("date"), "price")
    out = market.strike_path(prices, auctions, ["tso"])
    return out.select("tso", "date", r("market_price", 4).alias("market_price"), r("markup_path").alias("markup_path"), r("eeg_strike_used", 4).alias("eeg_strike_used"))


PANEL = "SELECT tso, month, price, last_value(st IGNORE NULLS) OVER (PARTITION BY tso ORDER BY month) AS strike FROM (SELECT m.*, CASE WHEN month(month) IN (2, 6, 10) THEN price + 10 END AS st FROM region_month m)"


@query("f8_flat_baselines", sql("""SELECT tso, round(avg(price) FILTER (i <= 36), 6) AS price_36m, round(avg(strike) FILTER (j <= 24), 6) AS strike_24m, round(arg_max(strike, month) FILTER (strike IS NOT NULL), 6) AS strike_last FROM (
    SELECT *, row_number() OVER (PARTITION BY tso ORDER BY month DESC) AS i, CASE WHEN strike IS NOT NULL THEN row_number() OVER (PARTITION BY tso, strike IS NULL ORDER BY month DESC) END AS j FROM p) GROUP BY tso""", "region_month", p=PANEL))
def f8(t: Tables) -> DataFrame:
    from ..operators.ordered import filled

    rows = t.region_month().withColumn("st", F.when(F.month("month").isin(2, 6, 10), F.col("price") + 10))
    panel = rows.withColumn("strike", filled("st", ["tso"], "month", backward=False))
    return rounded(forecast.flat_baselines(panel, ["tso"], "month", "price", "strike"), ["price_36m", "strike_24m", "strike_last"])


@query("f9_curtailment_forecast", sql("""SELECT tso, quarter, round(w.wind_mwh, 2) AS wind_mwh, round(l.load_mwh, 2) AS load_mwh, round(w.wind_mwh / l.load_mwh, 6) AS s, round(greatest(0, least(0.3, a + b * w.wind_mwh / l.load_mwh)), 6) AS cr_hat
    FROM w JOIN l USING (tso, quarter) JOIN fit USING (tso)""", "tso_quarter", w=_PROJ.format(g="0.01::DOUBLE", v="wind_mwh"), l=_PROJ.format(g="0.005::DOUBLE", v="load_mwh"),
    fit="SELECT tso, regr_slope(cr - 0.15, S) AS b, regr_intercept(cr - 0.15, S) AS a FROM tso_quarter GROUP BY tso"))
def f9(t: Tables) -> DataFrame:
    out = market.curtailment_forecast(t.tso_quarter().withColumn("cr", F.col("cr") - 0.15), *_span())
    return out.select("tso", "quarter", r("wind_mwh", 2).alias("wind_mwh"), r("load_mwh", 2).alias("load_mwh"), r("S").alias("s"), r("cr_hat").alias("cr_hat"))


PATHS, MONTHS_AHEAD = 500, 240
_U = "((CAST('0x' || substr(md5('{seed}|' || tso || '|' || scenario || '|' || path || '|' || k || '|{kind}|{side}'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_NORMAL = "sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})"


def _normal(kind: str) -> str:
    return _NORMAL.format(u1=_U.format(seed=42, kind=kind, side="r"), u2=_U.format(seed=42, kind=kind, side="a"))


STOCHASTIC = {
    "anc": "SELECT tso, median(price) AS level, max(month) AS anchor FROM region_month WHERE month BETWEEN '1997-01-01' AND '2000-12-01' GROUP BY tso",
    "wv": "SELECT tso, month, price, ln(price) AS y, sin(2 * pi() * month(month) / 12) AS sn, cos(2 * pi() * month(month) / 12) AS cs FROM region_month",
}


def _stochastic_ctes() -> dict[str, str]:
    from .models import fit_ctes

    out = {**STOCHASTIC, **fit_ctes("wv", "tso", None, "y", ["sn", "cs"])}
    season = "0.25 * (b_sn * sin(2 * pi() * {m} / 12) + b_cs * cos(2 * pi() * {m} / 12))"
    months = "((year({m}) - year(anchor)) * 12 + month({m}) - month(anchor)) / 12"
    out["rs"] = f"SELECT wv.tso, month, y - {season.format(m='month(month)')} AS ds, y - {season.format(m='month(month)')} - (ln(level) + {months.format(m='month')} * ln(1.05::DOUBLE)) AS z FROM wv JOIN anc USING (tso) JOIN f_b USING (tso)"
    out["rl"] = "SELECT *, lag(z) OVER (PARTITION BY tso ORDER BY month) AS zl FROM rs"
    out["ph"] = "SELECT tso, greatest(0, least(0.98, sum(z * zl) / sum(zl * zl))) AS phi FROM rl WHERE zl IS NOT NULL GROUP BY tso"
    out["sg"] = "SELECT tso, m, coalesce(CASE WHEN sd <> 0 THEN sd END, al) AS sigma FROM (SELECT tso, month(month) AS m, stddev_samp(z) AS sd FROM rs GROUP BY ALL) JOIN (SELECT tso, stddev_samp(z) AS al FROM rs GROUP BY tso) USING (tso)"
    out["la"] = "SELECT tso, max(month) AS lm, arg_max(ds, month) AS y FROM rs GROUP BY tso"
    out["st"] = f"""SELECT tso, scenario, path, k, CAST(lm + INTERVAL (k) MONTH AS DATE) AS month, phi, rate, lm, y - mu0 AS y0, mu0 FROM (SELECT *, ln(level) + {months.format(m='lm')} * rate AS mu0 FROM la JOIN ph USING (tso) JOIN anc USING (tso),
        (VALUES ('low', ln(1.03::DOUBLE)), ('base', ln(1.05::DOUBLE)), ('high', ln(1.07::DOUBLE))) AS g(scenario, rate)), range({PATHS}) AS p(path), range(1, {MONTHS_AHEAD + 1}) AS h(k)"""
    out["ep"] = f"SELECT st.*, sigma * 1.2::DOUBLE * {_normal('eps')} AS eps, 0.03::DOUBLE * {_normal('jit')} AS jit FROM st JOIN sg ON sg.tso = st.tso AND sg.m = month(st.month)".replace("|| tso ||", "|| st.tso ||")
    # The recursion written out: d_k = phi^k * y0 + sum_j phi^(k-j) * eps_j.
    out["dv"] = "SELECT a.tso, a.scenario, a.path, a.k, any_value(a.month) AS month, any_value(a.mu0 + a.k / 12 * a.rate + a.jit + pow(a.phi, a.k) * a.y0) + sum(pow(a.phi, a.k - b.k) * b.eps) AS lp FROM ep a JOIN ep b ON a.tso = b.tso AND a.scenario = b.scenario AND a.path = b.path AND b.k <= a.k GROUP BY ALL"
    out["px"] = f"SELECT dv.*, exp(lp + {season.format(m='month(month)')}) AS price FROM dv JOIN f_b USING (tso)"
    return out


def price_paths(t: Tables) -> DataFrame:
    models = market.price_simulation_models(t.region_month(), "tso", F.lit("1997-01-01").cast("date"), F.lit("2000-12-01").cast("date"))
    return simulate.simulate_ar_paths(models, "tso", PATHS, MONTHS_AHEAD, 42)


@query("f10_price_paths", sql("SELECT tso, scenario, CAST(path AS INT) AS path, month, round(price, 4) AS price FROM px", "region_month", **_stochastic_ctes()))
def f10(t: Tables) -> DataFrame:
    return rounded(price_paths(t), ["price"], 4)


@query("f10_price_bands", sql("SELECT tso, scenario, month, " + ", ".join(f"round(quantile_cont(price, {p / 100}), 4) AS p{p}" for p in (10, 50, 90)) + " FROM px GROUP BY ALL", "region_month", **_stochastic_ctes()))
def f10b(t: Tables) -> DataFrame:
    return rounded(aggregate.quantile_bands(price_paths(t), ["tso", "scenario", "month"], "price"), ["p10", "p50", "p90"], 4)


@query("f11_bootstrap", sql("SELECT tso, CAST(sim AS INT) AS sim, make_date(y, m, 1) AS ts, round(energy_kwh, 4) AS energy_kwh FROM sims", "region_month", sims=SIMS))
def f11(t: Tables) -> DataFrame:
    return rounded(simulated(t), ["energy_kwh"], 4)


@query("f12_representative_path", sql("SELECT tso, CAST(sim AS INT) AS sim, make_date(y, m, 1) AS ts, round(energy_kwh, 4) AS energy_kwh FROM sims JOIN rep USING (tso, sim)", "region_month", sims=SIMS, rep=REPRESENTATIVE))
def f12(t: Tables) -> DataFrame:
    return rounded(simulate.representative_path(simulated(t), ["tso"]), ["energy_kwh"], 4)


@query("f13_historical_energy")
def f13(t: Tables) -> DataFrame:
    model = learn.fit_correction(ml_rows(t), FEATS, **tree_settings())
    return energy.historical_monthly_energy(t.sites(), t.climate(), t.catalogue(), model, GRID_STEP, min_hours=20)


_SITE = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_COVERED = """SELECT * REPLACE (CASE scenario_id % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS tso) FROM scenarios"""


@query("f_energy_production", sql("""SELECT scenario_id, make_date(y, m, 1) AS date, round(n_turbines * energy_kwh / 1000, 6) AS mwh FROM sc JOIN rep USING (tso) JOIN sims USING (tso, sim)
    WHERE make_date(y, m, 1) >= cod AND make_date(y, m, 1) < cod + INTERVAL 240 MONTH""", "region_month", "scenarios", sc=_COVERED, sims=SIMS.replace("range(2026, 2046)", "range(1996, 2019)"), rep=REPRESENTATIVE))
def f_energy_production(t: Tables) -> DataFrame:
    """From monthly history over 500 simulations to the production of every scenario, as the revenue job takes it."""
    from ..plans.production import covering, energy_forecast, scenario_production

    hist = t.region_month().select("tso", F.year("month").alias("year"), F.month("month").alias("month"), F.col("wind_mwh").alias("energy_kwh"))
    scenarios = t.scenarios().withColumn("tso", F.element_at(F.array(*[F.lit(x) for x in _SITE]), (F.col("scenario_id") % 5 + 1).cast("int")))
    out = scenario_production(scenarios, energy_forecast(hist, ["tso"], **covering(scenarios)))
    return rounded(out, ["mwh"])
