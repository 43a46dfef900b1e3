"""Gap, artifact and filter rules on hand-made rows."""

from helpers import at, close, column, series
from pyspark.sql import functions as F

from loadstone.operators import cleaning as cl


def test_runs_of_five_are_filled_runs_of_six_are_flagged(spark):
    v = [10, None, None, None, None, None, 22] + [None] * 6 + [30]
    got = cl.fill_gaps(series(spark, v)).orderBy("ts").collect()
    close([r["demand_mw"] for r in got[:7]], [10, 12, 14, 16, 18, 20, 22])
    assert [r["demand_mw"] for r in got[7:13]] == [None] * 6
    assert [r["data_quality"] for r in got] == ["original"] + ["interpolated"] * 5 + ["original"] + ["gap"] * 6 + ["original"]


def test_short_runs_at_the_ends(spark):
    got = cl.fill_gaps(series(spark, [None, None, 5, 6, None, None]), chunk=2).orderBy("ts").collect()
    assert [r["data_quality"] for r in got] == ["interpolated"] * 2 + ["original"] * 2 + ["interpolated"] * 2
    assert [r["demand_mw"] for r in got] == [None, None, 5.0, 6.0, 6.0, 6.0]


def test_covariates_fill_six_of_a_long_run_and_hold_the_tail(spark):
    got = column(cl.interpolate_covariate(series(spark, [None, 0] + [None] * 8 + [9] + [None] * 8, name="t").withColumnRenamed("t", "t"), "t"), "t")
    assert got[0] is None and got[1] == 0.0
    close(got[2:8], [1, 2, 3, 4, 5, 6])
    assert got[8:10] == [None, None]
    assert got[11:17] == [9.0] * 6 and got[17:] == [None, None]


def test_all_null_series_stays_null(spark):
    got = cl.fill_gaps(series(spark, [None] * 3)).collect()
    assert {r["demand_mw"] for r in got} == {None} and {r["data_quality"] for r in got} == {"interpolated"}


def frame(spark, values, ahead=None):
    df = series(spark, values)
    return df.withColumn("forecast_mw", F.lit(ahead).cast("double"))


def test_near_zero_and_step_collapse(spark):
    flags = column(cl.flag_artifacts(frame(spark, [100, 100, 100, 5, 100, 39, 55])), "artifact")
    assert flags == [False, False, False, True, False, True, False]


def test_day_ahead_needs_the_low_scale_too(spark):
    assert column(cl.flag_artifacts(frame(spark, [100, 100, 58], 130.0)), "artifact")[-1] is True
    assert column(cl.flag_artifacts(frame(spark, [100, 100, 62], 130.0)), "artifact")[-1] is False


def test_missing_reading_counts_as_implausible_but_is_not_logged(spark):
    df = frame(spark, [100, 100, None, 0])
    assert column(cl.flag_artifacts(df), "artifact") == [False, False, True, True]
    assert cl.artifact_log(df).count() == 0


def test_excluded_reading_is_no_history_for_the_next(spark):
    log = cl.artifact_log(frame(spark, [100] * 20 + [30, 35])).orderBy("ts").collect()
    assert [r["mw"] for r in log] == [30.0, 35.0]
    assert log[1]["reason"] == "65% single-hour drop to 35% of the daily median"
    cleaned = cl.coerce_artifacts(frame(spark, [100] * 20 + [30, 35]), cl.artifact_log(frame(spark, [100] * 20 + [30, 35])))
    assert column(cleaned, "demand_mw")[-2:] == [None, None]


def test_only_the_trailing_rows_are_judged(spark):
    log = cl.artifact_log(frame(spark, [100, 100, 1] + [100] * 10 + [2]))
    assert [r["mw"] for r in log.collect()] == [2.0]


def test_empty_history_is_not_an_artifact(spark):
    assert column(cl.flag_artifacts(frame(spark, [5])), "artifact") == [False]


def test_unknown_class_is_never_conditioned(spark):
    df = frame(spark, [10, 11, 12, 13, 14], 50.0).unionByName(frame(spark, [1, 2, 3, 4, 5], 9.0).withColumn("region", F.lit("B")))
    classes = spark.createDataFrame([("A", "broken"), ("B", None)], "region string, revision_class string")
    got = cl.condition_anchor(df, classes)
    assert column(got.filter("region = 'A'"), "demand_mw") == [10.0, 11.0, 50.0, 50.0, 50.0]
    assert column(got.filter("region = 'B'"), "conditioned") == [False] * 5


def test_low_actuals_use_the_median_of_their_group(spark):
    df = spark.createDataFrame([("A", 100.0), ("A", 120.0), ("A", 9.0), ("B", 9.0), ("B", 8.0)], "region string, actual double")
    kept = cl.drop_low_actuals(df, ["region"]).collect()
    assert sorted((r["region"], r["actual"]) for r in kept) == [("A", 100.0), ("A", 120.0), ("B", 8.0), ("B", 9.0)]


def test_unknown_lead_is_kept(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "lead_hours int")
    assert sorted(str(r[0]) for r in df.filter(cl.keep_lead(1)).collect()) == ["1", "None"]


def test_as_of_models_differ_on_unarrived_hours(spark):
    cur = series(spark, [1, 2, 3]).drop("h")
    cap = spark.createDataFrame([("A", at(0), at(1)), ("A", at(1), at(2)), ("A", at(2), at(9))], "region string, ts timestamp, captured_at timestamp")
    tick = spark.createDataFrame([(at(2),), (at(2),), (None,)], "tick timestamp")
    null_row = cl.as_of(cur, cap, tick, 3)
    assert column(null_row, "demand_mw") == [1.0, 2.0, None]
    assert cl.as_of(cur, cap, tick, 3, absent=True).count() == 2


def test_as_of_holds_whole_days_up_to_the_tick(spark):
    """A tick holds the days of its window, the whole of its own day, and nothing else."""
    cur = series(spark, range(1, 24 * 8 + 1)).drop("h")
    cap = cur.select("region", "ts", F.col("ts").alias("captured_at"))
    ticks = spark.createDataFrame([(at(24 * 3 + 5),), (at(24 * 6),), (at(24 * 400),)], "tick timestamp")
    got = cl.as_of(cur, cap, ticks, 2)
    want = {}
    for tick in (24 * 3 + 5, 24 * 6):
        day = tick // 24 * 24
        held = [h for h in range(24 * 8) if day - 48 <= h <= day + 23]
        want[at(tick)] = (len(held), sum(h <= tick for h in held))
    assert {r["tick"]: (r["n"], r["seen"]) for r in got.groupBy("tick").agg(F.count("*").alias("n"), F.count("demand_mw").alias("seen")).collect()} == want
    assert cl.as_of(cur, cap, ticks.limit(0), 2).count() == 0
