"""The one-pass text source: ranges, headers, quoting, order and time bounds."""

import gzip
import random

import pytest

from galeledger.sources import market, telemetry
from galeledger.sources.headed import blocks, head_of, listed, packed_ranges, read_headed


@pytest.fixture
def files(tmp_path):
    rng = random.Random(4)
    want = {}
    for k in range(3):
        names = ["Start date", "v", "note"] if k else ["note", "v", "Start date"]
        rows, lines = [], []
        for i in range(rng.randint(200, 400)):
            cell = {"Start date": f"t{i}", "v": rng.choice(["", "1.5", "é"]), "note": rng.choice(["", "plain", "a;b", 'say "x"', " wide " * 9])}
            rows.append((cell["Start date"], cell["v"] or None))
            quoted = lambda s: '"' + s.replace('"', '""') + '"' if ";" in s or '"' in s else s
            lines.append(";".join(quoted(cell[n]) for n in names))
            if i % 50 == 7:
                lines.append(rng.choice(["", "   ", ";".join(names)]))
        ending = "\r\n" if k == 1 else "\n"
        body = "\ufeff" + ending.join([";".join(names), *lines]) + (ending if k else "")
        (tmp_path / f"f{k}.csv").write_bytes(body.encode())
        want[f"f{k}.csv"] = rows
    return tmp_path, want


@pytest.mark.parametrize("size", ["64", "1000", "4096", "128m"])
def test_rows_are_equal_under_any_split(spark, files, size):
    folder, want = files
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        raw = market.read_export(spark, f"{folder}/f*.csv", ["Start date", "v", "absent"])
        plan = raw._jdf.queryExecution().toString()
        assert plan.count("BatchScan") == 1 and "Join" not in plan and "Exchange" not in plan
        got = {}
        for r in sorted(raw.collect(), key=lambda r: (r.source_file, r.source_block, r.source_row)):
            assert r.absent is None
            got.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r["Start date"], r.v))
        assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_every_line_is_in_one_range(tmp_path):
    rng = random.Random(1)
    for case in range(30):
        lines = ["x" * rng.choice([0, 1, 2, 17]) for _ in range(rng.randint(1, 40))]
        path = str(tmp_path / f"{case}.txt")
        with open(path, "w", newline="") as f:
            f.write("head\n" + "\n".join(lines) + rng.choice(["", "\n"]))
        whole = [x for b in blocks(path, 0, 1 << 30, 5) for x in b]
        for step in (1, 2, 3, 7, 50):
            size = listed([path])[0][1]
            parts = [x for a in range(0, size, step) for b in blocks(path, a, min(a + step, size), 5) for x in b]
            assert parts == whole


def test_status_lines_with_few_cells_are_data(spark, tmp_path):
    text = "# log\none,comma\nTimestamp start,Timestamp end,IEC category\n2020-01-01 00:00:00,2020-01-01 01:00:00\n2020-01-01 02:00:00,2020-01-01 03:00:00,Full Performance\n"
    (tmp_path / "Status_K1_2020.csv").write_text(text)
    got = telemetry.read_status(spark, str(tmp_path)).orderBy("start_ts").collect()
    assert [(r.start_ts.hour, r.end_ts.hour, r.iec_category) for r in got] == [(0, 1, None), (2, 3, "Full Performance")]


def test_time_bounds_and_packed_files(spark, tmp_path):
    text = "# Date and time,Power (kW),Wind speed (m/s)\n" + "".join(f"2020-01-{d:02d} 12:00:00,{d},1\n" for d in range(1, 21)) + "21.01.2020 00:00,21,1\n"
    (tmp_path / "Turbine_Data_A_2020-01-01_x.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "Turbine_Data_A_2020-01-01_y.csv").write_text(text)
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "Turbine_Data_B_2020-01-01_z.csv").write_text("")
    got = telemetry.read_telemetry(spark, str(tmp_path), since="2020-01-05", until="2020-01-07").collect()
    assert sorted(r.power_kw for r in got) == [5, 5, 6, 6, 7, 7]
    assert telemetry.read_telemetry(spark, str(tmp_path)).count() == 42


def test_missing_headers_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Start date;x\n1;2\n")
    (tmp_path / "b.csv").write_text("Start;x\n1;2\n")
    with pytest.raises(Exception, match="'Start date' not found in .*b.csv"):
        read_headed(spark, f"file://{tmp_path}/*.csv", {"x": "x"}, ";", "first", ["Start date"]).collect()
    with pytest.raises(ValueError, match="no header"):
        head_of(str(tmp_path / "a.csv"), "comment", ",")
    with pytest.raises(FileNotFoundError, match="PATH_NOT_FOUND"):
        listed([str(tmp_path / "none*")])


def test_ranges_are_packed():
    parts = packed_ranges([(f"f{k}", 10) for k in range(300)] + [("big", 300 << 20), ("zip.gz", 400 << 20), ("none", 0)], 128 << 20)
    assert sum(len(p.ranges) for p in parts) == 300 + 3 + 1 and len(parts) < 10
