"""Chunked primitives must equal the plain ones, whatever the chunk size."""

import numpy as np
import pytest
from helpers import close, column, series
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadstone.operators.ensemble import ewma, latest_before
from loadstone.operators.features import autoregressive, impute_hours, temporal_snapshot
from loadstone.operators.quantiles import percentiles, ranked
from loadstone.operators.series import hour_spine, keep_one, newest, previous, rolling_mean, running, windowed, with_position


def noisy(spark, n=400, regions=("A", "B")):
    rng = np.random.default_rng(5)
    out = None
    for k, r in enumerate(regions):
        v = [None if rng.random() < 0.15 else round(float(rng.normal(100, 20)), 2) for _ in range(n + 37 * k)]
        df = series(spark, v, r, start=11 * k)
        out = df if out is None else out.unionByName(df)
    return out


@pytest.mark.parametrize("chunk", [7, 50, 4096])
def test_windowed_equals_plain_window(spark, chunk):
    df = noisy(spark)
    w = Window.partitionBy("region").orderBy("h")
    plain = df.withColumn("a", F.avg("demand_mw").over(w.rowsBetween(-24, -1))).withColumn("l", F.lag("demand_mw", 30).over(w)).withColumn(
        "c", F.sum("demand_mw").over(w.rowsBetween(-5, 9)))
    cut = windowed(df, ["region"], "h", {
        "a": lambda w: F.avg("demand_mw").over(w.rowsBetween(-24, -1)), "l": lambda w: F.lag("demand_mw", 30).over(w),
        "c": lambda w: F.sum("demand_mw").over(w.rowsBetween(-5, 9))}, before=30, after=9, chunk=chunk)
    for c in ("a", "l", "c"):
        close(column(cut, c), column(plain, c))


@pytest.mark.parametrize("chunk", [5, 64, 4096])
def test_running_equals_plain_cumulative(spark, chunk):
    df = noisy(spark)
    w = Window.partitionBy("region").orderBy("h")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.col("demand_mw")
    plain = df.select("*", F.sum(v).over(up).alias("s"), F.min(v).over(up).alias("lo"), F.max(v).over(up).alias("hi"),
                      F.last(v, True).over(up).alias("p"), F.first(v, True).over(on).alias("n"))
    cut = running(df, ["region"], "h", {"s": ("sum", v), "lo": ("min", v), "hi": ("max", v), "p": ("last", v), "n": ("next", v)}, chunk)
    for c in ("s", "lo", "hi", "p", "n"):
        close(column(cut, c), column(plain, c))


def test_rolling_mean_equals_the_frame_average(spark):
    df = noisy(spark)
    got = windowed(df, ["region"], "h", {
        "a": lambda w: rolling_mean("demand_mw", w, -30, 0), "b": lambda w: F.avg("demand_mw").over(w.rowsBetween(-30, 0)),
        "c": lambda w: rolling_mean("demand_mw", w, -5, 7), "d": lambda w: F.avg("demand_mw").over(w.rowsBetween(-5, 7))}, before=30, after=7, chunk=50)
    close(column(got, "a"), column(got, "b"))
    close(column(got, "c"), column(got, "d"))


def test_previous_skips_empty_chunks(spark):
    df = noisy(spark).filter("demand_mw IS NOT NULL AND (h < 40 OR h > 300)")
    plain = df.withColumn("p", F.lag("h", 1).over(Window.partitionBy("region").orderBy("h")))
    for chunk in (6, 4096):
        assert column(previous(df, ["region"], "h", {"p": "h"}, chunk), "p") == column(plain, "p")


def test_positions_count_rows_across_spans(spark):
    df = noisy(spark).filter("demand_mw IS NOT NULL")
    got = with_position(df, ["region"], "h", span=13)
    for r in ("A", "B"):
        assert column(got.filter(F.col("region") == r), "pos") == list(range(df.filter(F.col("region") == r).count()))


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.95, 1.0])
def test_percentiles_match_numpy(spark, q):
    rng = np.random.default_rng(3)
    data = {"A": rng.lognormal(3, 2, 501).round(3), "B": np.repeat([4.0, 4.0, 9.0], 5), "C": np.array([-3.5, 0.0, 2.25, -7.0]), "D": np.array([8.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("E", None)], "k string, v double")
    got = {r["k"]: r["p"] for r in percentiles(df, ["k"], {"p": (F.col("v"), q)}).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, q))


def test_narrow_ranges_do_not_end_in_one_cell(spark):
    """20,000 values between 1000.0 and 1001.5 lie in one magnitude bucket, but few in a cell."""
    from loadstone.operators.quantiles import _cells

    rng = np.random.default_rng(4)
    values = np.unique(np.round(rng.uniform(1000.0, 1001.5, 20_000), 9))
    df = spark.createDataFrame([("a", float(x)) for x in values] + [("b", 5.0)] * 10, "k string, v double")
    counts = df.groupBy("k", "v").count().withColumn("name", F.lit("p"))
    hit = _cells(counts, ["k", "name"], F.lit(0.37))
    assert hit.groupBy("k", "r", "cell").count().agg(F.max("count")).first()[0] <= 5
    got = {r["k"]: r["p"] for r in percentiles(df, ["k"], {"p": (F.col("v"), 0.37)}).collect()}
    assert abs(got["a"] - np.quantile(values, 0.37)) < 1e-9 and got["b"] == 5.0


def test_percentiles_of_several_columns_and_no_keys(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(11)], "a double, b double")
    r = percentiles(df, [], {"m": (F.col("a"), 0.5), "p": (F.col("b"), 0.9)}).first()
    assert (r["m"], r["p"]) == (5.0, 81.0)


def test_rank_is_global_and_breaks_ties(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 2, 5.0), ("A", 3, -1.0), ("A", 4, 900.0), ("A", 5, None)], "k string, t int, v double")
    got = {r["t"]: (r["rank"], r["rank_of"]) for r in ranked(df, ["k"], "v", ["t"]).collect()}
    assert got == {3: (1, 4), 1: (2, 4), 2: (3, 4), 4: (4, 4)}


def test_spine_fills_every_hour_of_each_series(spark):
    df = series(spark, [1, 2, 3, 4, 5]).filter("h IN (0, 1, 4)").unionByName(series(spark, [7], "B", 9))
    got = hour_spine(df.drop("h"), ["region"]).orderBy("region", "ts").collect()
    assert [(r["region"], r["demand_mw"]) for r in got] == [("A", 1.0), ("A", 2.0), ("A", None), ("A", None), ("A", 5.0), ("B", 7.0)]


def test_newest_and_keep_one_follow_the_order(spark):
    df = series(spark, range(10))
    assert sorted(column(newest(df, ["region"], "ts", 3), "h")) == [7, 8, 9]
    dup = df.unionByName(df.withColumn("demand_mw", F.col("demand_mw") + 100))
    assert column(keep_one(dup, ["region", "ts"], F.desc("demand_mw")), "demand_mw") == [float(100 + i) for i in range(10)]


def test_second_region_changes_nothing_for_the_first(spark):
    both, alone = noisy(spark), noisy(spark, regions=("A",))
    for c in ("demand_roll_168h_std", "demand_lag_24h", "demand_ratio_24h"):
        close(column(autoregressive(both).filter("region = 'A'"), c), column(autoregressive(alone), c))


def test_input_order_does_not_matter(spark):
    df = noisy(spark)
    shuffled = df.orderBy(F.xxhash64("h", "region")).repartition(7)
    close(column(autoregressive(shuffled, chunk=30), "demand_roll_72h_mean"), column(autoregressive(df), "demand_roll_72h_mean"))


def test_temporal_equals_positional_on_a_complete_grid(spark):
    df = series(spark, [50 + (i * 7) % 31 for i in range(250)])
    a, b = autoregressive(df).filter("h >= 168"), temporal_snapshot(df).filter("h >= 168")
    for c in ("demand_lag_168h", "demand_roll_24h_mean", "ramp_rate", "demand_momentum_long"):
        close(column(b, c), column(a, c))


def test_single_value_deviation_differs_between_training_and_serving(spark):
    df = series(spark, [5, 6])
    assert column(autoregressive(df), "demand_roll_24h_std") == [None, None]
    assert column(temporal_snapshot(df), "demand_roll_24h_std") == [None, 0.0]


def test_absent_hours_interpolate_up_to_six_then_look_back(spark):
    v = [10.0 + i for i in range(24)] + [None] * 6 + [40.0] + [None] * 7 + [90.0]
    got = column(impute_hours(series(spark, v)), "imputed_mw")
    close(got[24:30], [33 + (40 - 33) * k / 7 for k in range(1, 7)])
    close(got[31:38], [10.0 + (31 + k - 24) for k in range(7)])


def test_ewma_equals_recursion_over_chunks(spark):
    rng = np.random.default_rng(2)
    xs = [float(x) for x in rng.uniform(1, 9, 700)]
    xs[5] = -1.0
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(xs)], "k string, t long, v double")
    for alpha in (0.3, 0.02, 0.999, 1.0, 1e-7):
        s, want = None, []
        for x in xs:
            if x > 0:
                s = x if s is None else alpha * x + (1 - alpha) * s
                want.append(s)
        got = [r["ewma"] for r in ewma(df, ["k"], "t", "v", alpha).orderBy("t").collect()]
        close(got, want, 1e-9)


def test_as_of_lookup_is_strictly_before(spark):
    h = spark.sql("SELECT 'A' AS k, timestamp'2024-01-02' AS trained_at, 1.0D AS mape UNION ALL SELECT 'A', timestamp'2024-02-05', 2.0D")
    o = spark.sql("SELECT 'A' AS k, explode(array(timestamp'2024-01-02', timestamp'2024-01-02 00:00:01', timestamp'2024-02-05', timestamp'2024-09-01')) AS origin")
    got = [r["mape"] for r in latest_before(o, h, ["k"]).orderBy("origin").collect()]
    assert got == [None, 1.0, 1.0, 2.0]
