"""Vintage, pairing and drift semantics on hand-made rows."""

from helpers import at
from pyspark.sql import functions as F

from loadstone.operators import benchmark as bm
from loadstone.operators import drift as dr
from loadstone.operators import vintage as vt

READ = "region string, target_ts timestamp, captured_at timestamp, d double, df double"


def fold(spark, rows):
    return vt.vintages(spark.createDataFrame([("A", at(t), at(c), d, f) for t, c, d, f in rows], READ))


def test_first_value_is_pinned_and_small_moves_do_not_count(spark):
    r = fold(spark, [(0, 1, 100.0, None), (0, 2, 100.4, None), (0, 3, 100.9, 90.0), (0, 4, 101.0, 95.0)]).first()
    assert (r["first_seen_d"], r["last_d"], r["n_updates"]) == (100.0, 100.9, 1)
    assert (r["first_seen_df"], r["df_at"]) == (90.0, at(3))


def test_slow_drift_below_the_epsilon_is_caught_from_the_last_kept_value(spark):
    r = fold(spark, [(0, 1, 100.0, None), (0, 2, 100.3, None), (0, 3, 100.6, None)]).first()
    assert (r["last_d"], r["n_updates"]) == (100.6, 1)


def test_non_positive_readings_and_old_captures_are_ignored(spark):
    v = fold(spark, [(0, 1, 0.0, 5.0), (0, 2, -3.0, 5.0), (0, 3, 7.0, float("nan")), (0, 3 + 24 * 40, 9.0, None)])
    r = v.first()
    assert v.count() == 1 and (r["first_seen_d"], r["last_d"], r["first_seen_df"]) == (7.0, 7.0, None)


def test_placeholder_needs_the_same_capture(spark):
    v = fold(spark, [(0, 1, 50.0, 50.0), (1, 2, 50.0, None), (1, 3, 50.0, 50.0)]).select("target_ts", vt.was_placeholder().alias("p"))
    assert [r["p"] for r in v.orderBy("target_ts").collect()] == [True, False]


def test_reading_order_does_not_matter(spark):
    rows = [(0, c, 100.0 + c, None if c < 3 else 80.0) for c in range(1, 9)]
    assert fold(spark, rows).collect() == fold(spark, rows[::-1]).collect()


def test_gap_arithmetic(spark):
    rows = [(h, h, 10.0, 5.0 if h in (3, 4, 10) else None) for h in range(14)]
    r = vt.feed_gaps(fold(spark, rows)).first()
    assert (r["stale_hours"], r["longest_gap_hours"], r["longest_gap_end"]) == (3.0, 5.0, at(10))
    none = vt.feed_gaps(fold(spark, [(h, h, 10.0, None) for h in range(3)])).first()
    assert none["longest_gap_hours"] is None


def test_drop_reasons_are_first_match(spark):
    v = fold(spark, [(0, 0, 10.0, None), (1, 6, 10.0, 9.0), (2, 2, 10.0, 10.0), (3, 3, 10.0, 10.0), (3, 4, 30.0, None), (4, 4, 10.0, 8.0), (5, 5, 10.0, 8.0)])
    p = spark.createDataFrame([("A", at(5), 7.0, None)], "region string, target_ts timestamp, predicted double, revised_df double")
    got = [r["drop_reason"] for r in bm.pair_hours(v, p).orderBy("target_ts").collect()]
    assert got == ["no_df", "stale_capture", "unresolved_stub", "first_seen_placeholder", "no_prediction", None]
    pair = bm.pair_hours(v, p).filter("drop_reason IS NULL").first()
    assert pair["official_revised"] == 8.0


def test_too_few_fresh_records_are_unknown(spark):
    v = fold(spark, [(h, h, 10.0, None) for h in range(10)])
    assert vt.classify(v).first()["revision_class"] == "unknown"


def test_regrade_ignores_equal_and_non_positive_values(spark):
    rec = spark.createDataFrame([("A", at(i), 90.0, 100.0) for i in range(4)], "region string, ts timestamp, predicted double, actual double")
    new = spark.createDataFrame([("A", at(0), 100.004), ("A", at(1), 0.0), ("A", at(2), 125.0)], "region string, ts timestamp, actual double")
    got = dr.regrade(rec, new).orderBy("ts").collect()
    assert [r["actual"] for r in got] == [100.0, 100.0, 125.0, 100.0]
    assert [r["regraded"] for r in got] == [False, False, True, False] and got[2]["shift_pct"] == 20.0


def test_visibility_has_hysteresis(spark):
    h = spark.createDataFrame([("A", i, m) for i, m in enumerate([21.0, 22.5, 21.0, 19.5, 19.0, 21.9])], "region string, k long, mape double")
    got = [r["visible"] for r in dr.visibility(h, ["region"], "k", "mape").orderBy("k").collect()]
    assert got == [True, False, False, False, True, True]


def test_grade_bands(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (7.0,), (12.1,), (None,)], "m double")
    assert [r[0] for r in df.select(dr.grade(F.col("m"), "24h")).collect()] == ["excellent", "target", "acceptable", "rollback", None]


def test_every_reading_of_an_hour_counts(spark):
    from datetime import timedelta

    rows = [("A", at(0), at(10) + timedelta(minutes=m), d, None) for m, d in ((5, 100.0), (20, 100.0), (35, 200.0), (50, 200.2))]
    r = vt.vintages(spark.createDataFrame(rows, READ)).first()
    assert (r["first_seen_d"], r["captured_at"], r["last_d"], r["n_updates"]) == (100.0, at(10) + timedelta(minutes=5), 200.0, 1)


def test_any_split_into_batches_equals_one_batch(spark):
    from datetime import timedelta

    values = [100.0, 100.0, 100.4, 100.4, 100.9, 100.9, 50.0, 50.0, 50.0, 51.0]
    published = {3: 90.0, 4: 95.0, 8: 96.0}
    rows = [("A", at(0), at(1) + timedelta(minutes=10 * k), d, published.get(k)) for k, d in enumerate(values)]
    whole = vt.vintages(spark.createDataFrame(rows, READ)).first()
    for cut in range(1, len(rows)):
        first = vt.vintages(spark.createDataFrame(rows[:cut], READ))
        assert vt.vintages(spark.createDataFrame(rows[cut:], READ), first).first() == whole


def test_retention_is_an_argument(spark):
    rows = [("A", at(0), at(1), 7.0, None), ("A", at(0), at(3 + 24 * 40), 9.0, None)]
    df = spark.createDataFrame(rows, READ)
    assert vt.vintages(df).first()["last_d"] == 7.0
    assert vt.vintages(df, retention_hours=None).first()["last_d"] == 9.0
