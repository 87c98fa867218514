"""Operators on raw readings: brute force, edge cases, held-out accuracy."""

from __future__ import annotations

import datetime as dt
import math
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import impute, spikes
from plumbline.operators.grid import regular_grid
from plumbline.operators.impute import filled, unusable
from plumbline.operators.keyed import heavy_keys, key_totals
from plumbline.operators.readings import readings
from plumbline.operators.rolling import rolling_totals
from plumbline.operators.spikes import implausible
from plumbline.sources import rejects
from plumbline.sources.rejects import accepted, parse_records, rejected

SCHEMA = "obs_id long, day date, interval double, detid string, flow double, occ double, error double, city string, speed double, loaded_at timestamp_ntz"
D0 = dt.date(2023, 3, 1)


def rows(spark, items, extra=False):
    """items: (city, detid, day offset, interval, flow, occ[, minutes late])."""
    out = []
    for i, (city, det, d, s, flow, occ, *late) in enumerate(items):
        day = None if d is None else D0 + dt.timedelta(d)
        num = lambda v: None if v is None else float(v)
        out.append((i + 1, day, num(s), det, num(flow), num(occ), 0.0, city, None, dt.datetime(2023, 3, 1) + dt.timedelta(minutes=i + (late[0] if late else 0))))
    t = spark.createDataFrame(out, SCHEMA)
    if extra:  # names the operators use inside
        t = t.withColumns({c: F.lit("x") for c in ("slot", "n", "v", "step", "chunk", "h", "sec", "day_no", "bucket", "at_day", "hour", "x", "y", "field", "key_value", "flow_filled", "guess")})
    return t


NAN = float("nan")
BASE = [
    ("x", "a", 0, 0.0, 10.0, 0.1), ("x", "a", 0, 3601.5, 20.0, 0.2), ("x", "a", 0, 3601.5, 22.0, 0.2, 9), ("x", "a", 0, 5000.0, NAN, None),
    ("x", "a", 0, 8 * 3600.0, -99.0, 0.3), ("x", "a", 3, 90000.0, 5.0, 0.1), ("y", "a", 1, 100.0, 7.0, 0.5), ("y", "N/A", 1, 100.0, 7.0, 0.5),
    (None, "a", 1, 5.0, 1.0, 0.1), ("x", "a", None, 5.0, 1.0, 0.1), ("x", "a", 2, None, 1.0, 0.1), ("x", " ", 2, 5.0, 1.0, 0.1), ("x", "b", 2, math.inf, 1.0, 0.1),
]


def steps(spark, *items):
    return spark.createDataFrame(list(items) or [], "city string, detid string, step_s int, lanes int, fclass string, limit_kmh int")


@pytest.mark.parametrize("extra", [False, True])
def test_grid(spark, extra):
    t = rows(spark, BASE, extra)
    det = steps(spark, ("x", "a", 3600, 1, None, None), ("y", "a", 7, 1, None, None))
    got = {(r.day_key, r.slot): r for r in regular_grid(t, det, max_gap=2).collect()}
    # From 2023-03-01 0 h to 2023-03-05 1 h (the interval of day 3 runs past midnight); y has a step that doesn't divide the day.
    assert len(got) == 4 * 24 + 2
    at = lambda d, s: (got[(20230300 + d, s)].n_readings, got[(20230300 + d, s)].flow, got[(20230300 + d, s)].state)
    assert at(1, 0) == (1, 10.0, "observed") and at(1, 1) == (2, 22.0, "observed") and at(1, 3) == (0, 22.0, "carried") and at(1, 4) == (0, None, "missing")
    assert at(1, 8) == (1, None, "missing") and at(5, 1) == (1, 5.0, "observed") and at(5, 0) == (0, None, "missing")


def test_grid_carries_over_midnight(spark):
    t = rows(spark, [("x", "a", 0, 23 * 3600.0, 4.0, 0.1), ("x", "a", 1, 5 * 3600.0, 6.0, 0.1)])
    got = {(r.day_key, r.slot): r.state for r in regular_grid(t, steps(spark, ("x", "a", 3600, 1, None, None)), max_gap=2).collect()}
    assert got == {(20230301, 23): "observed", (20230302, 0): "carried", (20230302, 1): "carried", (20230302, 2): "missing", (20230302, 3): "missing", (20230302, 4): "missing", (20230302, 5): "observed"}


def test_grid_carries_over_days(spark):
    """Steps of a day: the gap reaches over days without a reading, and over a reading without a value."""
    t = rows(spark, [("x", "a", 0, 5.0, 4.0, 0.1), ("x", "a", 3, 5.0, None, 0.1), ("x", "a", 4, 5.0, 6.0, 0.1)])
    got = {r.day_key: (r.state, r.flow) for r in regular_grid(t, steps(spark, ("x", "a", 86400, 1, None, None), ("x", "b", 7200, 1, None, None)), max_gap=3).collect()}
    assert got == {20230301: ("observed", 4.0), 20230302: ("carried", 4.0), 20230303: ("carried", 4.0), 20230304: ("carried", 4.0), 20230305: ("observed", 6.0)}
    got = {r.day_key: r.state for r in regular_grid(t, steps(spark, ("x", "a", 86400, 1, None, None)), max_gap=1).collect()}
    assert got == {20230301: "observed", 20230302: "carried", 20230303: "missing", 20230304: "missing", 20230305: "observed"}


def test_empty(spark):
    t = rows(spark, BASE).limit(0)
    assert regular_grid(t, steps(spark)).count() == rolling_totals(t).count() == implausible(t).count() == key_totals(t).count() == heavy_keys(t).count() == readings(t, "flow").count() == filled(t).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_rolling(spark, extra):
    rng = np.random.default_rng(3)
    items = [("x", d, int(day), float(s), float(f), 0.01) for d in "ab" for day, s, f in zip(rng.integers(0, 50, 60), rng.permutation(60), rng.integers(1, 9, 60)) if d == "a" or day > 20]
    got = rolling_totals(rows(spark, items + BASE[9:], extra)).collect()
    for det in "ab":
        own = [(d, f) for _, x, d, _, f, _ in items if x == det]
        first, last = min(own)[0], max(own)[0]
        mine = {r.day_key: r for r in got if r.city == "x" and r.detid == det}
        assert len(mine) == last - first + 1
        for c in range(first, last + 1):
            r = mine[int((D0 + dt.timedelta(c)).strftime("%Y%m%d"))]
            for p, n, s, a in ((7, r.n_7d, r.flow_sum_7d, r.flow_avg_7d), (30, r.n_30d, r.flow_sum_30d, r.flow_avg_30d)):
                held = [f for d, f in own if c - p < d <= c]
                assert n == len(held) and s == sum(held) and (a is None) == (not held) and (not held or a == pytest.approx(np.mean(held)))
            assert r.n_day == sum(d == c for d, _ in own)


def test_rolling_counts_an_instant_once(spark):
    r = rolling_totals(rows(spark, BASE)).where("city = 'x' and day_key = 20230301").first()
    assert r.n_day == 4 and r.flow_sum_7d == 32.0 and r.flow_avg_7d == 16.0


LINES = [
    ("2023-05-17,84300,189,208,0.06,0,b,55.8", None), ("2023-05-17,84300,189,208,0.06,0,b,", None), ('"2023-05-17","84300","1""8","2","0.1","0","b",""', None), ("2023-05-17,1,a, 2 ,+.5e-1,q,b,n/a\r", None),
    ('2023-05-17,1,"a\nb",2,0.1,0,"c,d",', None), ("2023-05-17,1,,,,,,", None), ("2024-02-29,0,a,1,0.,0,b,", None),
    ('2023-05-17,1,a",2,0.1,0,b,', "quoting"), ('2023-05-17,1,"a,2,0.1,0,b,', "quoting"), ('2023-05-17,1,"a" ,2,0.1,0,b,', "quoting"), ('2023-05-17,1,"a"x,2,0.1', "quoting"), ('2023-05-17,1,1"2,2,"0.1,0,b,', "quoting"),
    ("", "columns"), (" ", "columns"), ("a,b", "columns"), ("2023-05-17,1,a,2,0.1,0,b,,", "columns"), ("2023-05-17,1,a,2,0.1,0,b", "columns"), (None, "columns"), ("2023-05-17;1;a;2;0.1;0;b;", "columns"), ("x,1,a,2,0.1,0,b,,,", "columns"),
    ("2023-02-30,1,a,2,0.1,0,b,", "values"), ("2023-5-17,1,a,2,0.1,0,b,", "values"), (",1,a,2,0.1,0,b,", "values"), ("2023-05-17,,a,2,0.1,0,b,", "values"), ("2023-05-17,-1,a,2,0.1,0,b,", "values"), ("2023-05-17,1,a,nan,0.1,0,b,", "values"),
    ("2023-05-17,1,a,1_000,0.1,0,b,", "values"), ("2023-05-17,1,a,2,1e999,0,b,", "values"), ("2023-05-17,1,a,２,0.1,0,b,", "values"), ("2023-05-17,1,a,2,inf,0,b,", "values"), ("2023-05-17,1,a,.,0.1,0,b,", "values"), ("2023-05-17,0x1,a,2,0.1,0,b,", "values"),
]


def raw_lines(spark, lines):
    return spark.createDataFrame([(i, "f.csv", i, s) for i, s in enumerate(lines)], "line_id long, file_name string, line_no int, line string")


def test_rejects(spark):
    # Many times over and out of order: an open quote must never touch another record.
    rng = np.random.default_rng(4)
    order = rng.permutation(np.repeat(np.arange(len(LINES)), 12))
    t = raw_lines(spark, [LINES[i][0] for i in order]).coalesce(2)
    got = {r.line_id: r for r in parse_records(t).collect()}
    assert len(got) == len(order)
    for k, i in enumerate(order):
        assert got[k].reason == LINES[i][1], (LINES[i], got[k].reason)
    r = got[int(np.flatnonzero(order == 2)[0])]
    assert (r.day, r.interval, r.detid, r.flow, r.occ, r.city, r.speed) == (dt.date(2023, 5, 17), 84300.0, '1"8', 2.0, 0.1, "b", None)
    r = got[int(np.flatnonzero(order == 4)[0])]
    assert r.detid == "a\nb" and r.city == "c,d"
    assert accepted(t).count() + rejected(t).count() == len(order) and parse_records(t.limit(0)).count() == 0


def test_rejects_long_line(spark):
    got = [r.reason for r in parse_records(raw_lines(spark, ["2023-05-17,1," + "a" * 20_000_000 + ",2,0.1,0,b,", "2023-05-17,1,a,2,0.1,0,b,"])).orderBy("line_id").collect()]
    assert got == [None, None]


def test_rejects_of_many_files(spark):
    t = spark.createDataFrame([(i, f"f{i % 700}.csv" if i % 3 else None, i, '2023-05-17,1,"a,2,0.1,0,b,' if i % 50 == 7 else f"2023-05-17,{i},a,2,0.1,0,b,") for i in range(3000)], "line_id long, file_name string, line_no int, line string").coalesce(1)
    got = parse_records(t).collect()
    assert len(got) == 3000 and all((r.reason == "quoting") == (r.line_id % 50 == 7) and (r.reason or r.interval == r.line_id) for r in got)


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"[ \t]{0,2}[+-]?([0-9]{1,4}(\.[0-9]{0,3})?|\.[0-9]{1,3})([eE][+-]?[0-9]{1,3})?[ \t]{0,2}", fullmatch=True) | st.text(alphabet="0123456789.eE+-_ \tinfax", min_size=1, max_size=8), st.booleans())
def test_numbers_as_the_rule_says(number, quoted):
    """A number is ASCII digits with optional sign, point and exponent, blanks around it; it must be finite."""
    parser = rejects._Parser()
    s = f'"{number}"' if quoted else number
    got = parser.settle([None], [f"2023-05-17,1,a,{s},0.1,0,b,"]).to_pylist()[0]
    right = re.fullmatch(r"[ \t]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*", number) is not None and math.isfinite(float(number))
    assert got["reason"] == (None if right else "values") and (not right or got["flow"] == float(number))


def day_shape(h):
    return 200 + 150 * np.sin((h - 6) / 24 * 2 * np.pi)


def series(days=28, seed=0):
    rng = np.random.default_rng(seed)
    return [["x", "a", d, h * 3600.0 + float(rng.integers(0, 900)), round(float(day_shape(h) * rng.lognormal(0, 0.1))), round(float(0.05 + day_shape(h) / 4000 * rng.lognormal(0, 0.1)), 4)] for d in range(days) for h in range(24)]


def flags(spark, items, extra=False):
    return {r.obs_id - 1: (r.flow_flag, r.occ_flag) for r in implausible(rows(spark, items, extra)).collect()}


def test_spikes(spark):
    s = series()
    want = {}
    s[100][4], want[100] = 3000.0, ("spike", None)
    s[200][4], s[201][4] = 2000.0, 2100.0
    want |= {200: ("spike", None), 201: ("spike", None)}
    s[300][4], want[300] = 2.0, ("spike", None)
    s[350][5], want[350] = 0.95, (None, "spike")
    for k in range(400, 409):
        s[k][4] = 123.0
        want[k] = ("stuck", None)
    s[450][4], want[450] = -40.0, ("bounds", None)
    s[460][4], want[460] = 5e6, ("bounds", None)
    s[470][5], want[470] = 1.4, (None, "bounds")
    for k, f in enumerate((1.5, 2.2, 3.0, 3.2, 2.4, 1.6)):  # a surge that builds up and fades
        s[500 + k][4] = round(s[500 + k][4] * f)
    for k, o in enumerate((0.15, 0.3, 0.45, 0.35, 0.2)):  # a queue
        s[550 + k][5] = o
    s[600][4] = s[601][4] = None
    s[602][5] = NAN
    for k in range(620, 627):
        s[k][4] = 77.0  # seven alike are no run
    items = [tuple(x) for x in s]
    want |= {len(items): ("spike", None), len(items) + 1: ("stuck", None), len(items) + 2: ("bounds", None)}
    items += [(*items[100], 5), (*items[404], 5), (None, "a", 0, 1.0, -3.5, 0.1)]
    assert flags(spark, items) == want
    assert flags(spark, items, True) == want


def test_spikes_of_low_occupancy(spark):
    """A jump from 0.03 to 0.3 is one, alone or in a pair; a rise by half is none."""
    rng = np.random.default_rng(4)
    s = [x[:5] + [round(float(0.03 * rng.lognormal(0, 0.1)), 4)] for x in series()]
    s[300][5] = 0.3
    s[400][5], s[401][5] = 0.31, 0.34
    s[500][5] = 0.045
    assert flags(spark, [tuple(x) for x in s]) == {k: (None, "spike") for k in (300, 400, 401)}


def test_quiet_detector_may_rest(spark):
    rng = np.random.default_rng(1)
    s = [("x", "q", d, h * 3600.0, float(rng.integers(0, 5)) if 8 <= h < 20 else 0.0, 0.0) for d in range(20) for h in range(24)]
    assert flags(spark, s) == {}
    busy = series()
    for k in range(200, 212):
        busy[k][4] = 0.0
    assert set(flags(spark, [tuple(x) for x in busy])) == set(range(200, 212))


@pytest.mark.parametrize("rows_a_piece", [60, 300, 10**6])
def test_slices_agree_with_whole(spark, monkeypatch, rows_a_piece):
    s = series(70, 7)
    rng = np.random.default_rng(8)
    for k in rng.choice(len(s), 40, replace=False):
        s[k][4] *= 12
    for at in (24 * 19 - 4, 24 * 39 + 20, 24 * 45):
        for k in range(at, at + 10):
            s[k][5] = 0.0777
    items = [tuple(x) for x in s]
    t = np.array([(D0 - dt.date(1970, 1, 1)).days * 86400 + i[2] * 86400 + i[3] for i in items])
    order = np.argsort(t, kind="stable")
    f, o = (x.flag for x in spikes.judge(np.zeros(len(s), int), t[order], np.array([i[4] for i in items], float)[order], np.array([i[5] for i in items], float)[order]))
    whole = {int(order[k]): (spikes.NAMES[f[k]], spikes.NAMES[o[k]]) for k in range(len(s)) if f[k] or o[k]}
    monkeypatch.setattr(spikes, "PIECE_ROWS", rows_a_piece)
    assert flags(spark, items) == whole


def test_stuck_run_over_a_border_and_a_gap(spark, monkeypatch):
    """Four readings of one value, ten days without any, four more of the same value: one run, wherever the series is cut."""
    s = [x for x in series(60, 2) if not 20 <= x[2] < 30]
    at = next(i for i, x in enumerate(s) if x[2] == 30)
    for k in range(at - 4, at + 4):
        s[k][4] = 111.0
    items = [tuple(x) for x in s]
    want = {k: ("stuck", None) for k in range(at - 4, at + 4)}
    for n in (10**6, 100, 26):
        monkeypatch.setattr(spikes, "PIECE_ROWS", n)
        assert flags(spark, items) == want


def test_groups_are_gathered_once():
    """A group of many batches is joined once, so its gathering is linear; groups come out whole and in order."""
    import pyarrow as pa

    keys = np.repeat(np.arange(6), [3, 40_000, 1, 1, 9000, 2])
    table = pa.table({"k": keys, "v": np.arange(keys.size)})
    for rows in (1, 5000, 10**6):
        blocks = list(spikes._groups(iter(table.to_batches(max_chunksize=700)), 1, rows))
        assert np.array_equal(np.concatenate([b[1] for b in blocks]), np.arange(keys.size))
        assert all(a[0][-1] != b[0][0] for a, b in zip(blocks, blocks[1:]))
    assert len(list(spikes._groups(iter(table.to_batches(max_chunksize=700)), 1, 5000))) >= 3


def test_rolling_scale_is_the_windows(spark):
    x = np.random.default_rng(5).normal(size=200)
    g = np.repeat([0, 1], [150, 50])
    m, s = spikes.rolling_scale(g, x, 5)
    for i in (0, 3, 100, 149, 150, 199):
        w = np.array([x[j] for j in range(max(i - 5, 0), min(i + 6, 200)) if g[j] == g[i]])
        assert m[i] == pytest.approx(np.median(w)) and s[i] == pytest.approx(1.4826 * np.median(np.abs(w - np.median(w))))


@pytest.mark.parametrize("extra", [False, True])
def test_keys(spark, extra):
    t = rows(spark, BASE + [("x", "a", 0, 1.0, 2.0, 0.1)] * 30, extra)
    got = {(r.field, r.key_value): r for r in key_totals(t).collect()}
    assert set(got) == {("city", "x"), ("city", "y"), ("detid", "a"), ("detid", "b")}
    r = got[("detid", "a")]
    assert r.n_rows == 40 and r.all_rows == 43 and r.flow_n == 38 and r.flow_max == 22.0 and r.flow_avg == pytest.approx(r.flow_sum / 38)
    assert {tuple(r) for r in heavy_keys(t).collect()} == {("city", "x"), ("detid", "a")}


def test_fill_accuracy_and_marks(spark, data):
    raw = spark.read.parquet(f"{data}/utd19_u.parquet")
    h = F.pmod(F.xxhash64("obs_id"), F.lit(25))
    blank = raw.withColumns({"flow": F.when(h == 0, None).otherwise(F.col("flow")), "occ": F.when(h == 1, NAN).otherwise(F.col("occ")), "detid": F.when(h == 2, "?").otherwise(F.col("detid"))})
    got = filled(blank).persist()
    assert got.count() == raw.count() and got.columns[: len(raw.columns)] == raw.columns
    assert got.where("not flow_filled and not occ_filled and not detid_filled").select(*raw.columns).exceptAll(blank).count() == 0
    assert got.where("flow is null or isnan(flow) or occ is null or isnan(occ) or (detid is null and city is not null)").count() == 0
    assert unusable(got).distinct().count() == got.selectExpr("sum(int(flow_filled) + int(occ_filled) + int(detid_filled))").first()[0]
    truth = raw.select("obs_id", F.col("flow").alias("f"), F.col("detid").alias("d"), F.col("city").alias("c"))
    pdf = got.join(truth, "obs_id").where("f between 0 and 5000 and flow_filled and city is not null").toPandas()
    error = np.log((pdf.flow + 5) / (pdf.f + 5)).abs().median()
    plain = np.log((pdf.groupby("city").f.transform("median") + 5) / (pdf.f + 5)).abs().median()
    assert error < 0.3 and error < 0.5 * plain
    named = got.join(truth, "obs_id").where("detid_filled and length(d) > 2 and lower(d) not in ('null', 'none', 'unknown') and city is not null").toPandas()
    assert (named.detid == named.d).mean() > (named.d == named.groupby("city").d.transform(lambda s: s.mode().iat[0])).mean()
    got.unpersist()


@pytest.mark.parametrize("parted", [False, True])
def test_missing_detector_is_the_mode_of_its_row(spark, data, monkeypatch, parted):
    """The posterior of each nameless row by itself, with its own day, hour, weekend, flow, occ and habits; the same if cities are parted."""
    raw = spark.read.parquet(f"{data}/utd19_u.parquet").where("city is not null")
    raw = raw.withColumn("detid", F.when(F.pmod(F.xxhash64("obs_id"), F.lit(20)) > 0, F.col("detid")))
    fitted = impute.fit(raw, steps=4)
    m = fitted.mixture
    if parted:
        fitted.parts = {r.city: (3, 2) for r in raw.select("city").distinct().collect()}
    monkeypatch.setattr(impute, "fit", lambda *_: fitted)
    got = filled(raw).where("detid_filled").select("obs_id", F.col("detid").alias("guess"))
    asked = raw.withColumns({f"_{k}": c for k, c in impute._variables(raw).items()}).join(got, "obs_id").toPandas()
    by = {k: p.sort_values("detid").reset_index(drop=True) for k, p in fitted.days.toPandas().groupby(["city", "day_no"])}
    same = []
    for r in asked.itertuples(index=False):
        r = dict(zip(asked.columns, r))
        d = by.get((r["city"], r["_day_no"]))
        d = by[(r["city"], impute.NO_DAY)] if d is None else d
        one = np.ones(len(d))
        logs = m.log_density((one * r["_hour"]).astype(int), (one * r["_weekend"]).astype(int), one * r["_x"] - d.a.to_numpy(), one * r["_y"] - d.b.to_numpy())
        p = np.log((np.exp(logs) * (np.stack(d.w) + 1e-12)).sum(1)) + np.log(d.n_day.to_numpy(float))
        p += sum(np.stack(d[h])[:, r[f"_{h}"]] for h in ("align", "part") if r[f"_{h}"] >= 0)
        same.append(r["guess"] == d.detid[int(p.argmax())])
    assert len(same) > 100 and all(same)


def test_fit_stops_by_likelihood(spark, data):
    raw = spark.read.parquet(f"{data}/utd19_u.parquet")
    m = impute.fit(raw).mixture
    rises = np.diff(m.likelihood)
    least = 1e-3 * np.abs(m.likelihood[1:])
    assert m.converged and (rises[:-1] >= least[:-1]).all() and rises[-1] < least[-1] and len(m.likelihood) < 60
    assert not impute.fit(raw, steps=2).mixture.converged


def test_a_step_takes_one_exponential_a_cell_and_class(monkeypatch):
    """The sums of a step against Bayes' rule cell by cell, with whatever may be missing; the turns of the detectors' weights take no exponentials of their own."""
    import pyarrow as pa

    rng, sizes, k, turns = np.random.default_rng(3), [50, 1, 120], 4, 3
    n = sum(sizes)
    m = impute.Mixture.start(k, np.array([1.0, 0.6]))
    count, hour, weekend = rng.integers(1, 9, n), rng.integers(-1, 24, n).astype("i4"), rng.integers(-1, 2, n).astype("i4")
    x, y = (np.where(rng.random(n) < 0.2, NAN, rng.normal(0, 1, n)) for _ in range(2))
    a, b = np.array([3.0, NAN, 4.0]), np.array([-2.0, -3.0, NAN])
    m.a, m.b = 2.0, -1.0
    own = np.repeat(np.arange(3), sizes)
    off = [np.where(np.isnan(v), d, v)[own] for v, d in ((a, m.a), (b, m.b))]
    cells = pa.StructArray.from_arrays([pa.array(v) for v in (hour, weekend, count, (x + off[0]) * count, (y + off[1]) * count)], names=["hour", "weekend", "n", "sx", "sy"])
    batch = pa.RecordBatch.from_arrays([pa.array(["c"] * 3), pa.array(["p", "q", "r"]), pa.array(a), pa.array(b), pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype("i4"), cells)], names=["city", "detid", "a", "b", "cells"])

    p = np.exp(m.log_density(hour, weekend, x, y))
    w = np.tile(m.weight, (3, 1))
    for _ in range(turns):
        r = p * w[own] / (p * w[own]).sum(1, keepdims=True) * count[:, None]
        w = np.array([r[own == d].sum(0) + impute.PRIOR * m.weight for d in range(3)])
        w /= w.sum(1, keepdims=True)
    want = np.zeros((k, 8 + impute.HOURS))
    ex, ey, vx, vy, vxy = m.conditional(x, y)
    want[:, 0] = r.sum(0)
    for i in range(n):
        if hour[i] >= 0:
            want[:, 1 + hour[i]] += r[i]
        if weekend[i] >= 0:
            want[:, 1 + impute.HOURS + weekend[i]] += r[i]
    for j, v in enumerate((ex, ey, ex**2 + vx, ey**2 + vy, ex * ey + vxy)):
        want[:, 3 + impute.HOURS + j] = (r * v).sum(0)
    likelihood = count @ np.log((p * w[own]).sum(1))

    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda v, *more, **named: (taken.append(np.size(v)), exp(v, *more, **named))[1])
    for most in (10, 10**6):
        monkeypatch.setattr(impute, "CELLS_AT_ONCE", most)
        taken.clear()
        (got,) = impute._expect(m, turns)(iter([batch]))
        sums = got.column(1).to_numpy()
        assert np.allclose(sums[:-2].reshape(k, -1), want) and sums[-2:] == pytest.approx([likelihood, count.sum()])
        assert sum(taken) == n * k


def test_words_with_and_without_spaces(spark):
    """Names that are read without the search for spaces are judged as those that need it."""
    from plumbline.functions.values import NO_VALUE_WORDS, has_word

    around = ["", " ", "\t", "\n", "\x0b", "\u00a0", "\u2003", "\u2028", "\x00", "\x1f", "\x7f", "\u00e9", "\u200b", "\U0001f600"]
    items = [(i, a + w + b) for i, (a, w, b) in enumerate((a, w, b) for a in around for b in around for w in (*NO_VALUE_WORDS, "NA", "Null", "a", "!", "~", "n a", "0", "\u00e9"))]
    got = {r.i: r.v for r in spark.createDataFrame([*items, (-1, None)], "i int, s string").select("i", has_word(F.col("s")).alias("v")).collect()}
    # What Java calls \s and \p{Z}.
    spaces = "".join(c for c in map(chr, range(0x3001)) if c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] == "Z")
    assert got.pop(-1) is False and got == {i: s.strip(spaces).lower() not in NO_VALUE_WORDS for i, s in items}


def test_fill_edges(spark):
    t = rows(spark, [*BASE, ("z", None, 0, 5.0, None, None), ("z", "c", 0, 5.0, None, None), (None, None, None, None, None, None)], True)
    got = {r.obs_id: r for r in filled(t).collect()}
    assert len(got) == len(BASE) + 3 and got[len(BASE) + 1].detid == "c" and got[len(BASE) + 1].flow_filled is True
    last = got[len(BASE) + 3]
    assert last.flow is not None and last.occ is not None and last.detid is None and not last.detid_filled and last.unfilled == ["detid"]
    assert all(r.unfilled == [] and r.detid is not None for r in got.values() if r.city == "x")
    found = {tuple(r) for r in unusable(filled(t)).collect()}
    assert {(len(BASE) + 3, f) for f in ("flow", "occ", "detid")} <= found and (len(BASE) + 1, "detid") in found


def test_found_cells_come_through_the_fill(spark, data):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as out:
        unusable(filled(spark.read.parquet(f"{data}/utd19_u.parquet"), steps=2)).explain()
    assert "ArrowEvalPython" in out.getvalue() and "FlatMapCoGroupsInPandas" in out.getvalue()
