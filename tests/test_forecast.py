"""Metrics, baselines, ensembles, folds and intervals on hand-made rows."""

import numpy as np
import pytest
from helpers import at, close, column, series
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadstone.functions import calendar as cal
from loadstone.functions import pricing as pr
from loadstone.functions import weather as wx
from loadstone.operators import backtest as bt
from loadstone.operators import baseline as bl
from loadstone.operators import downsample as ds
from loadstone.operators import ensemble as en
from loadstone.operators import grid as gr
from loadstone.operators import metrics as mt
from loadstone.operators import scenario as sc
from loadstone.operators import weather as wt
from loadstone.operators.series import hour_number, newest_counted


def one(spark, col, rows, schema):
    return spark.createDataFrame(rows, schema).agg(col.alias("x")).first()["x"]


def test_metric_edges(spark):
    s = "actual double, predicted double"
    assert one(spark, mt.mape(), [(0.0, 5.0)], s) == float("inf")
    assert one(spark, mt.positive_mape(), [(-1.0, 5.0)], s) is None
    assert one(spark, mt.r2(), [(5.0, 4.0), (5.0, 6.0)], s) == 0.0
    assert one(spark, mt.smape(), [(0.0, 0.0), (100.0, 50.0)], s) == pytest.approx(200 * 50 / 150)
    assert one(spark, mt.wape(), [(100.0, 90.0), (300.0, 330.0)], s) == pytest.approx(10.0)


def test_null_weather_stays_null(spark):
    df = spark.createDataFrame([(None, None, None)], "t double, w double, s double")
    r = df.select(wx.cdd("t"), wx.hdd("t"), wx.heat_index("t", "s"), wx.wind_power("w"), wx.solar_factor("s")).first()
    assert list(r) == [None] * 5


def test_wind_power_cut_in_and_out(spark):
    df = spark.createDataFrame([(v / wx.MPH_TO_MS,) for v in (2.9, 6.0, 12.0, 20.0, 25.1)], "w double")
    close([r[0] for r in df.select(wx.wind_power("w")).collect()], [0.0, 0.125, 1.0, 1.0, 0.0])


def test_circular_mean_and_mode_tie(spark):
    rows = [(at(0), 1, 350.0, 3.0, 10.0), (at(0), 2, 10.0, 1.0, None)]
    df = spark.createDataFrame(rows, "ts timestamp, point_id int, wind_direction_10m double, weather_code double, temperature_2m double")
    r = wt.spatial_mean(df, ["ts"], 2, means=["temperature_2m"]).first()
    assert min(r["wind_direction_10m"], 360 - r["wind_direction_10m"]) < 1e-9
    assert (r["weather_code"], r["temperature_2m"], r["complete"]) == (1.0, 10.0, True)


def test_holidays_with_observed_days(spark):
    df = spark.sql("SELECT explode(sequence(date'2021-01-01', date'2022-12-31')) AS day")
    got = [str(r["day"]) for r in cal.with_holiday_flag(df, "day").filter("is_holiday = 1").orderBy("day").collect()]
    assert {"2021-05-31", "2021-06-18", "2021-06-19", "2021-07-05", "2021-11-25", "2021-12-24", "2021-12-31", "2022-01-17", "2022-06-20", "2022-12-26"} <= set(got)
    assert "2021-06-20" not in got and len([d for d in got if d.startswith("2021-11")]) == 2


def test_price_tiers(spark):
    df = spark.createDataFrame([(50.0,), (80.0,), (95.0,), (100.0,)], "d double")
    got = [r[0] for r in df.select(pr.price("d", F.lit(100.0))).collect()]
    close(got, [50.0, 60.0, 50 * np.exp(0.75), 1000.0])


def test_seasonal_naive_steps_back_over_holes(spark):
    v = [float(i) for i in range(48)]
    v[40] = None
    got = bl.seasonal_naive(series(spark, v), 30)
    p = {r["lead_hours"]: r["predicted"] for r in got.collect()}
    assert p[1] == 24.0 and p[17] == 16.0 and p[24] == 47.0 and p[25] == 24.0
    assert bl.seasonal_naive(series(spark, v[:20]), 30).count() == 0


def test_resolver_falls_back_to_equal_weights_for_all(spark):
    s = spark.createDataFrame([("A", "x", 2.0), ("A", "y", 4.0), ("B", "x", 2.0), ("B", "y", None)], "region string, model string, mape double")
    w = {(r["region"], r["model"]): r["weight"] for r in en.weights(s, ["region"]).collect()}
    assert w[("A", "x")] == pytest.approx(8 / 9) and w[("B", "x")] == w[("B", "y")] == 0.5
    low = {(r["region"], r["model"]): r["weight"] for r in en.usable_weights(s, ["region"]).collect()}
    assert low[("B", "x")] == 1.0 and ("B", "y") not in low


def test_combine_renormalises_over_present_members(spark):
    f = spark.createDataFrame([("A", 1, "x", 10.0), ("A", 1, "y", 20.0), ("A", 2, "y", 20.0)], "region string, t int, model string, predicted double")
    w = spark.createDataFrame([("A", "x", 0.75), ("A", "y", 0.25)], "region string, model string, weight double")
    got = {r["t"]: r["predicted"] for r in en.combine(f, w, ["region"], ["region", "t"]).collect()}
    assert got == {1: 12.5, 2: 20.0}


def test_walk_forward_folds_are_oldest_first(spark):
    sizes = spark.createDataFrame([("A", 1000), ("B", 700)], "region string, n int")
    got = [(r["region"], r["fold"], r["test_start"], r["test_end"]) for r in bt.walk_forward_folds(sizes, 100).orderBy("fold").collect()]
    assert got == [("A", 1, 800, 900), ("A", 2, 900, 1000)]
    newest_first = bt.rolling_splits(sizes, 3, 168, 720).orderBy("region", "fold").collect()
    assert [(r["region"], r["fold"], r["test_start"]) for r in newest_first] == [("A", 0, 832)]


def test_interval_never_narrows(spark):
    f = spark.createDataFrame([("A", k, 100.0) for k in range(1, 401)], "region string, lead_hours int, predicted double")
    a = spark.createDataFrame([("A", 12, -10.0, 12.0), ("A", 84, -8.0, 9.0), ("A", 360, -30.0, 40.0)], "region string, effective_lead int, lower_error double, upper_error double")
    r = bt.widening_interval(f, a).orderBy("lead_hours").collect()
    up, low = [x["upper"] for x in r], [x["lower"] for x in r]
    assert all(b >= a for a, b in zip(up, up[1:])) and all(b <= a for a, b in zip(low, low[1:]))
    assert (up[83], low[83], up[-1], low[-1]) == (112.0, 90.0, 140.0, 70.0)
    one_anchor = bt.widening_interval(f, a.limit(1))
    assert one_anchor.count() == 0


def test_sustained_drift_needs_a_straight_line(spark):
    recent = series(spark, [100 + (i % 24) for i in range(200)])
    line = spark.createDataFrame([("A", k, 90.0 + k * 0.15) for k in range(1, 401)], "region string, lead_hours int, predicted double")
    got = {r["prefix"]: r["reason"] for r in bl.sanity(line, recent, horizons=(24, 168, 400)).collect()}
    assert got == {24: None, 168: None, 400: "sustained_drift"}
    few = {r["reason"] for r in bl.sanity(line, recent.limit(100), horizons=(24,)).collect()}
    assert few == {None}


def test_bridge_ends_at_the_first_hole(spark):
    df = series(spark, [1, 2, 3, 4, 5, None, 7])
    end = spark.createDataFrame([("A", at(1))], "region string, last_featured_ts timestamp")
    assert column(bl.bridge(end, df), "ts") == [at(2), at(3), at(4)]
    r = bl.forecast_start(end, df).first()
    assert (r["forecast_start"], r["binding_term"], r["bridge_hours"]) == (at(5), "featured_bridged", 3)
    stuck = spark.createDataFrame([("A", at(4))], "region string, last_featured_ts timestamp")
    assert bl.forecast_start(stuck, df).first()["binding_term"] == "featured"


def test_verdict_reasons(spark):
    rows = {"few": [1.0, 2.0], "split": [10.0, -1.0, -1.0, -1.0], "noise": [1.0, -0.9, 1.1, -1.0, 0.5], "sure": [1.0, 1.2, 0.9, 1.1]}
    df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs], "k string, delta double")
    got = {r["k"]: (r["reason"], r["winner"]) for r in mt.paired_verdict(df, ["k"]).collect()}
    assert got["few"][0] == "too_few_windows" and got["split"][0] == "mean_median_disagree" and got["noise"][0] == "within_noise"
    assert got["sure"] == ("decisive", "treatment")


def test_normal_smoothing_wraps_the_year(spark):
    cells = spark.createDataFrame([("A", d, 0, 1.0 if d == 366 else 0.0) for d in range(1, 367)], "region string, doy int, hour int, t double")
    got = {r["doy"]: r["t"] for r in wt.smooth_normal(cells, ["t"]).collect()}
    assert got[1] == pytest.approx(1 / 15) and got[7] == pytest.approx(1 / 15) and got[8] == 0.0 and got[359] == pytest.approx(1 / 15) and got[358] == 0.0
    short = cells.filter("doy <= 15")
    assert sorted(r["t"] for r in wt.smooth_normal(short, ["t"]).collect()) == [0.0] * 15


def lttb_plain(x, y, k):
    n, size = len(x), (len(x) - 2) / (k - 2)
    out, a = [0], 0
    for b in range(k - 2):
        lo, hi = int(b * size) + 1, min(int((b + 1) * size) + 1, n - 1)
        hi2 = min(int((b + 2) * size) + 1, n)
        cx, cy = (x[hi:hi2].mean(), y[hi:hi2].mean()) if hi2 > hi else (x[-1], y[-1])
        area = np.abs((x[a] - cx) * (y[lo:hi] - y[a]) - (x[a] - x[lo:hi]) * (cy - y[a]))
        a = lo + int(np.argmax(area))
        out.append(a)
    return [*out, n - 1]


def test_lttb_equals_the_direct_walk(spark):
    rng = np.random.default_rng(9)
    x = np.arange(900.0)
    y = np.cumsum(rng.normal(0, 3, 900)).round(3)
    y[300:340] = 5.0
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    got = sorted(r["x"] for r in ds.lttb(df, ["k"], "x", "y", 40, chunk=11).collect())
    assert got == [x[i] for i in lttb_plain(x, y, 40)]
    assert ds.lttb(df.limit(30), ["k"], "x", "y", 40).count() == 30


def test_nearest_prefers_the_earlier_on_a_tie_and_respects_the_tolerance(spark):
    left = spark.createDataFrame([("A", at(10)), ("A", at(20))], "region string, p timestamp")
    right = spark.createDataFrame([("A", at(9), 1.0), ("A", at(11), 2.0), ("A", at(23), 3.0)], "region string, ts timestamp, v double")
    got = [r["nearest_v"] for r in gr.nearest(left, right, ["region"], "p", "ts", "v", 5400).orderBy("p").collect()]
    assert got == [1.0, None]


def test_interpolation_hits_grid_points_and_clamps(spark):
    cells = [("A", t, w, s, 0, 1 + t / 100 + w / 1000) for t in sc.TEMP_F for w in sc.WIND_MPH for s in sc.SOLAR_WM2]
    grid = spark.createDataFrame(cells, "region string, temp_f double, wind_mph double, solar_wm2 double, step int, factor double")
    req = spark.createDataFrame([(1, "A", 5.0, 0.0, 0.0), (2, "A", 7.5, -5.0, 100.0), (3, "A", 90.0, 0.0, 0.0)], "request int, region string, temp_delta double, wind_delta double, solar_delta double")
    got = {r["request"]: r["factor"] for r in sc.interpolate(req, grid).collect()}
    close([got[1], got[2], got[3]], [1.05, 1.07, 1.2])


def test_all_regions_excluded_gives_an_empty_summary_row(spark):
    load = spark.createDataFrame([("A", at(h), 100.0) for h in range(3)], "region string, ts timestamp, demand_mw double")
    cap = spark.createDataFrame([("A", 50.0, True, "G")], "region string, capacity_mw double, unreliable boolean, grid string")
    r = gr.national_summary(load, cap).first()
    assert (r["reporting_regions"], r["utilization_pct"], r["top_region"]) == (1, None, None)


def test_bootstrap_interval_holds_the_mean(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(rng.normal(3, 1, 400))], "k string, id long, d double")
    r = bt.bootstrap_mean(df, ["k"], "d", "id").first()
    assert r["ci_low"] < r["mean"] < r["ci_high"] and 0.12 < r["ci_high"] - r["ci_low"] < 0.3


def test_bootstrap_equals_rows_drawn_one_by_one(spark):
    """Null values take no part, a key without values has no interval, and no row is copied per draw."""
    import hashlib

    cdf = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    rows = [("A", i, None if i % 5 == 0 else float(i * i % 17)) for i in range(40)] + [("B", 1, None), ("C", 3, 2.5)]
    df = spark.createDataFrame(rows, "k string, id long, d double")
    out = bt.bootstrap_mean(df, ["k"], "d", "id", 50)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r for r in out.collect()}
    for key in "ABC":
        means = []
        for b in range(1, 51):
            pairs = []
            for k, i, v in rows:
                u = (int(hashlib.md5(f"{i}|{b}".encode()).hexdigest()[:8], 16) % 1_000_003 + 0.5) / 1_000_003
                if k == key and v is not None:
                    pairs.append((v, sum(u > c for c in cdf)))
            if sum(c for _, c in pairs):
                means.append(sum(v * c for v, c in pairs) / sum(c for _, c in pairs))
        if not means:
            assert (got[key]["mean"], got[key]["n"], got[key]["ci_low"], got[key]["ci_high"]) == (None, 0, None, None)
            continue
        close([got[key]["ci_low"], got[key]["ci_high"]], list(np.quantile(means, [0.025, 0.975])))


@pytest.mark.parametrize("keys", [["region"], ["region", "horizon"]])
def test_newest_counted_equals_the_ranked_window(spark, keys):
    """Chunks of any size give the rows and ranks of one window, also for a limit that differs by key."""
    rows = [(r, z, at(h), float(h)) for r, step in (("A", 1), ("B", 7), ("C", 50)) for z in (3, 40) for h in range(0, 120, step)]
    df = spark.createDataFrame(rows, "region string, horizon int, ts timestamp, v double")
    df = df if len(keys) == 2 else df.filter("horizon = 3")
    n = F.col("horizon") * 2 if len(keys) == 2 else 30
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    want = sorted(map(tuple, df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).collect()))
    for span in (1, 9, 24, 1000):
        got = newest_counted(df, keys, hour_number("ts"), n, "k", span)
        assert sorted(map(tuple, got.collect())) == want
    assert newest_counted(df.filter("false"), keys, hour_number("ts"), n).count() == 0


def test_recompute_too_soon(spark):
    from loadstone.operators.backtest import recompute_cadence

    hours = [(0, 3), (0, 51), (24, 0), (168, 5), (168 + 143, 5), (168 + 143 + 144, 1), (None, 4)]
    runs = spark.createDataFrame([(None if h is None else at(h), n) for h, n in hours], "run_at timestamp, recomputed int")
    got = [(r["age_days"], r["unexpected"]) for r in recompute_cadence(runs).orderBy("run_at").collect()]
    assert got == [(None, False), (7.0, False), (143 / 24, True), (6.0, False)]


def _below(node, found):
    kids = node.children()
    for i in range(kids.size()):
        _below(kids.apply(i), found)
    found.append(node)
    return found


def test_requests_meet_their_curves_in_one_last_join(spark, monkeypatch):
    monkeypatch.setattr(sc, "PART_ROWS", 2, raising=False)
    cells = [(r, t, w, s, k, 1.0 + t / 100 + k / 1000) for r in ("A", "B") for t in sc.TEMP_F for w in sc.WIND_MPH for s in sc.SOLAR_WM2 for k in (0, 1)]
    grid = spark.createDataFrame(cells, "region string, temp_f double, wind_mph double, solar_wm2 double, step long, factor double")
    env = spark.createDataFrame([("A", "temp_f", 5.0, False), ("C", "temp_f", 5.0, False)], "region string, axis string, delta double, in_range boolean")
    asked = [(i, r, 5.0, 0.0, 0.0) for i, r in enumerate(["A"] * 9 + ["B", "C", None, "A"])]
    req = spark.createDataFrame(asked, "request long, region string, temp_delta double, wind_delta double, solar_delta double")
    out = sc.with_fallback(req, grid, env, 3)
    got = {(r["request"], r["step"]): (round(r["factor"], 6), r["source"]) for r in out.collect()}
    assert out.count() == len(got) == 3 * len(asked)
    for i, region, *_ in asked:
        source = {"A": "grid_extrapolated", "B": "grid"}.get(region, "heuristic")
        curve = [1.05, 1.051, 1.051] if region in ("A", "B") else [1.025] * 3
        assert [got[i, k] for k in range(3)] == [(f, source) for f in curve]
    for made in (out, sc.interpolate(req, grid)):
        for node in _below(made._jdf.queryExecution().optimizedPlan(), []):
            if node.nodeName() == "Join":
                for side in (node.left(), node.right()):
                    names = side.output().mkString(" ")
                    assert not ("_cube" in names and "request" in names)  # else the next join sorts whole curves a request
