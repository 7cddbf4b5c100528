"""The telemetry job on small files, against pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from galeledger.plans.telemetry import HOURS, Labels, read_site, standard_hours
from galeledger.sources.catalogue import catalogue_rows

LABELS = Labels("Time stamp", "P", "W", turbine="WT")
CATALOGUE = '{"A": {"rated_power_kw": 2000, "rotor_diameter_m": 90, "default_hub_height_m": 80, "Cut-in wind speed": 3}, "B": {"rated_power_kw": 1, "rotor_diameter_m": 1}}'


def tables(spark):
    meta = spark.createDataFrame([("t1", "A", 50.0, None, None), ("t2", "A", None, 9.0, 99.0), ("s_T01", "A", None, None, None)], "turbine_id string, turbine_type string, lat double, lon double, hub_height_m double")
    sites = spark.createDataFrame([("s", 1.0, 2.0, 3.0)], "site_id string, lat double, lon double, hub_height_m double")
    return meta, catalogue_rows(spark.createDataFrame([(CATALOGUE,)], "json string")), sites


def write(path, step, rows, turbine="t1", label="Time stamp", flag=None):
    start = dt.datetime(2024, 3, 1)
    head = f" {label},P,W,WT{',Q' if flag else ''}\n"
    body = "".join(f"{(start + i * step):%d.%m.%Y %H:%M},{p},{w},{turbine}{f',{flag[i]}' if flag else ''}\n" for i, (p, w) in enumerate(rows))
    path.write_text(head.replace("Time stamp", "Time\u00a0stamp") + body + "bad,1,1,x" + (",1" if flag else "") + "\n", encoding="utf-8")


def fine_rows(seed):
    rng = np.random.default_rng(seed)
    power = lambda: rng.choice(["", "-5", "0", f"{rng.random() * 900:.3f}", f"{rng.random() * 900:.3f}", f"{rng.random() * 900:.3f}", "5000"])
    wind = lambda: rng.choice(["", f"{rng.random() * 12:.2f}", f"{rng.random() * 12:.2f}"])
    return [(str(power()), str(wind())) for _ in range(400)]


def brute(rows, flags=None, top=2000.0):
    df = pd.DataFrame(rows, columns=["p", "w"]).apply(pd.to_numeric, errors="coerce")
    df.index = pd.date_range("2024-03-01", periods=len(df), freq="10min")
    df["ok"] = ~((df.p < 0) | df.p.isna() | ((df.w >= 3) & (df.p <= 0))) if flags is None else True
    df = df[np.array(flags) == 1] if flags is not None else df
    df = df[df.p.notna() & (df.p >= 0) & (df.p <= top)]
    out = {}
    for hour, g in df.groupby(df.index.floor("h")):
        if g.ok.mean() >= 2 / 3 and g.w.notna().any():
            out[hour.to_pydatetime()] = (g.p.sum() / 6, g.w.mean())
    return out


def test_ten_minute_and_hourly_files(spark, tmp_path):
    fine = fine_rows(1)
    write(tmp_path / "a.csv", dt.timedelta(minutes=10), fine)
    write(tmp_path / "b.csv", dt.timedelta(hours=1), [("10", "5"), ("", "5"), ("-1", "5"), ("9999", "1"), ("20", "")], "t2")
    meta, catalogue, sites = tables(spark)
    out = standard_hours(read_site(spark, str(tmp_path / "*.csv"), "s", LABELS), meta, catalogue, sites, max_power=2000.0)
    assert out.columns == HOURS
    got = out.collect()
    hours = {r.ts: (r.energy_kwh, r.wind_speed_ms) for r in got if r.turbine_id == "t1"}
    want = brute(fine)
    assert hours.keys() == want.keys() and len(want) > 5 and all(np.allclose(hours[h], want[h]) for h in want)
    plain = sorted((r.ts.hour, r.energy_kwh, r.wind_speed_ms) for r in got if r.turbine_id == "t2")
    assert plain == [(0, 10.0, 5.0), (4, 20.0, None)]
    one = {(r.turbine_id, r.lat, r.lon, r.hub_height_m, r.rated_power_kw) for r in got}
    assert one == {("t1", 50.0, 2.0, 80.0, 2000.0), ("t2", 1.0, 9.0, 99.0, 2000.0)}
    assert all(math.isclose(r.specific_power_wpm2, 2e6 / (math.pi * 45 ** 2)) for r in got)


def test_quality_flag_and_numbered_files(spark, tmp_path):
    fine = fine_rows(2)
    flags = [int(x) for x in np.random.default_rng(3).integers(0, 2, len(fine))]
    write(tmp_path / "x.csv", dt.timedelta(minutes=10), fine, flag=flags)
    meta, catalogue, sites = tables(spark)
    rows = read_site(spark, str(tmp_path / "x.csv"), "s", Labels("Time stamp", "P", "W", quality="Q"))
    got = {r.ts: (r.energy_kwh, r.wind_speed_ms) for r in standard_hours(rows, meta, catalogue, sites, quality=True, max_power=2000.0).where("turbine_id = 's_T01'").collect()}
    want = brute(fine, flags)
    assert got.keys() == want.keys() and all(np.allclose(got[h], want[h]) for h in want)


def test_what_raises(spark, tmp_path):
    meta, catalogue, sites = tables(spark)
    job = lambda name, labels=LABELS, m=meta: standard_hours(read_site(spark, str(tmp_path / name), "s", labels), m, catalogue, sites)
    write(tmp_path / "half.csv", dt.timedelta(minutes=30), [("1", "1")] * 9)
    write(tmp_path / "one.csv", dt.timedelta(minutes=10), [("1", "1")])
    write(tmp_path / "good.csv", dt.timedelta(minutes=10), [("1", "1")] * 9)
    write(tmp_path / "who.csv", dt.timedelta(minutes=10), [("1", "1")] * 9, "t9")
    for name in ("half.csv", "one.csv"):
        with pytest.raises(ValueError, match="time step"):
            job(name)
    with pytest.raises(ValueError, match="no metadata"):
        job("who.csv")
    with pytest.raises(ValueError, match="not found"):
        job("good.csv", Labels("Time stamp", "power", "W"))
    typed = lambda kind: spark.createDataFrame([("t1", kind, 1.0, 1.0, 1.0)], meta.schema)
    with pytest.raises(ValueError, match="not in catalogue"):
        job("good.csv", m=typed("Z"))
    with pytest.raises(ValueError, match="cut-in"):
        job("good.csv", m=typed("B"))
