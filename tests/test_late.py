"""Scans and streams against plain recursion: any cut and order of the batches gives one result."""

import random
from datetime import timedelta

import pytest
from helpers import at
from pyspark.sql import functions as F

from loadstone.operators import drift, scans
from loadstone.operators.ensemble import usable
from loadstone.operators.series import newest
from loadstone.streaming import late, ledger
from loadstone.streaming import operators as so
from loadstone.streaming.sinks import read_latest, stream_table, update_log

DAY = 86400


def recursion(rows, kind, alpha=0.3):
    """Results of one series' rows (time, value) in order of time."""
    out, top, streak, prev, first, s = [], None, 0, None, True, None
    for t, v in sorted(rows, key=lambda r: r[0]):
        if kind == "monotone":
            top = v if top is None or (v is not None and v > top) else top
            out.append(v is not None and v >= top)
        elif kind == "streaks":
            streak = streak + 1 if v else 0
            out.append((streak, streak >= 3))
        elif kind == "changes":
            out.append(first or v != prev)
            prev, first = v, False
        else:
            if v is not None and v > 0:
                s = float(v) if s is None else alpha * v + (1 - alpha) * s
            out.append(s)
    return out


VALUES = {
    "monotone": (lambda: scans.monotone("v"), "long", lambda r: r.choice([None, *range(50)])),
    "streaks": (lambda: scans.streaks("v"), "boolean", lambda r: r.choice([True, True, True, False, None]) if r.random() < 0.5 else True),
    "changes": (lambda: scans.changes("v"), "string", lambda r: r.choice([None, "a", "b"])),
    "smoothing": (lambda: scans.smoothing("v", usable("v"), 0.3), "double", lambda r: r.choice([None, -1.0, float(r.randint(1, 90))])),
}


def shown(kind, row):
    return {"monotone": lambda: row["served"], "streaks": lambda: (row["streak"], row["alert"]), "changes": lambda: row["kept"], "smoothing": lambda: row["ewma"]}[kind]()


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (g == w or abs(g - w) <= 1e-9 * abs(w)), (g, w)


@pytest.mark.parametrize("kind", VALUES)
def test_scans_equal_recursion_at_every_chunk_size(spark, kind):
    make, dtype, draw = VALUES[kind]
    fold = make()
    rng = random.Random(3)
    series = {k: [(t, draw(rng)) for t in rng.sample(range(400), n)] for k, n in (("x", 150), ("y", 3), ("z", 1))}
    df = spark.createDataFrame([(k, t, v) for k, rows in series.items() for t, v in rows], f"k string, t long, v {dtype}")
    for chunk in (1, 7, 1000):
        got = scans.scan(df, ["k"], "t", fold, chunk).orderBy("t").collect()
        for k, rows in series.items():
            same([shown(kind, r) for r in got if r["k"] == k], recursion(rows, kind))


def test_smoothing_of_any_alpha(spark):
    rng = random.Random(9)
    rows = [(t, rng.uniform(1, 9)) for t in range(300)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, t long, v double")
    for alpha in (1e-9, 0.001, 0.3, 0.97, 1.0):
        got = scans.scan(df, ["k"], "t", scans.smoothing("v", usable("v"), alpha), 16).orderBy("t").collect()
        same([r["ewma"] for r in got], recursion(rows, "smoothing", alpha))


@pytest.mark.parametrize("kind", VALUES)
def test_streams_do_not_depend_on_cut_or_order(spark, tmp_path, kind):
    """Rows come late, twice, and again in a replayed batch; decisions that no longer hold are logged."""
    make, dtype, draw = VALUES[kind]
    fold = make()
    rng = random.Random(7)
    rows = [(k, at(t), draw(rng)) for k, n in (("x", 60), ("y", 2)) for t in rng.sample(range(900), n)]
    schema = f"k string, t timestamp, v {dtype}"
    for turn in range(2):
        order = rng.sample(rows, len(rows))
        cuts = [order[:25], order[25:26], order[26:50], order[50:] + order[:5]]
        path = str(tmp_path / f"{kind}-{turn}")
        run = late.fold_batch(path, ["k"], "t", fold, 7 * DAY)
        for n, part in enumerate(cuts):
            run(spark.createDataFrame(part, schema), n)
            if n == 2:
                run(spark.createDataFrame(part, schema), n)  # replayed
        got = late.read_decided(spark, path, ["k"], "t").orderBy("t").collect()
        for k in ("x", "y"):
            same([shown(kind, r) for r in got if r["k"] == k], recursion([(t, v) for s, t, v in rows if s == k], kind))
        gone = late.read_decided(spark, path, ["k"], "t", "retracted")
        assert gone.count() > 0 or kind in ("monotone", "changes")


def test_a_late_row_re_decides_only_what_it_changes(spark, tmp_path):
    path = str(tmp_path / "few")
    run = late.fold_batch(path, ["k"], "t", scans.monotone("v"), DAY)
    run(spark.createDataFrame([("a", at(24 * d), 10 * d) for d in range(30)], "k string, t timestamp, v long"), 0)
    run(spark.createDataFrame([("a", at(24 * 10 + 1), 125)], "k string, t timestamp, v long"), 1)
    log = spark.read.parquet(f"{path}/decided").filter("batch_id = 1").orderBy("_t").collect()
    assert [(r["v"], r["served"]) for r in log] == [(125, True), (110, False), (120, False)]
    assert [r["v"] for r in late.read_decided(spark, path, ["k"], "t", "retracted").orderBy("t").collect()] == [110, 120]
    assert spark.read.parquet(f"{path}/chunks").filter("batch_id = 1").count() <= 4


def test_a_lost_history_is_refused(spark, tmp_path):
    run = late.fold_batch(str(tmp_path / "lost"), ["k"], "t", scans.monotone("v"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        run(spark.createDataFrame([("a", at(0), 1)], "k string, t timestamp, v long"), 4)


def test_same_time_and_missing_time(spark, tmp_path):
    path = str(tmp_path / "ties")
    run = late.fold_batch(path, ["k"], "t", scans.monotone("v"))
    run(spark.createDataFrame([("a", at(0), 5), ("a", at(0), 9), ("a", None, 7), (None, at(1), 3)], "k string, t timestamp, v long"), 0)
    run(spark.createDataFrame([("a", at(0), 2)], "k string, t timestamp, v long"), 1)
    got = {(r["k"], r["v"]) for r in late.read_decided(spark, path, ["k"], "t").collect()}
    assert ("a", 9) in got and ("a", 7) not in got and ("a", 2) not in got


def files(spark, path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return stream_table(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_fifo_and_streaks_over_files(spark, tmp_path):
    snaps = [[("x", at(0), "a"), ("x", at(1), "a")], [("x", at(3), "a"), ("x", at(4), "c")], [("x", at(2), "b")]]
    r = late.snapshot_fifo(files(spark, str(tmp_path / "s"), snaps, "series string, scored_at timestamp, hash string"), 3, path=str(tmp_path / "so")).first()
    assert (r["hashes"], r["scored_at"]) == (["b", "a", "c"], [at(2), at(3), at(4)])
    runs = [[("x", at(0), True), ("x", at(1), True)], [("x", at(3), True)], [("x", at(2), True), ("x", at(4), False)]]
    got = late.breach_streaks(files(spark, str(tmp_path / "r"), runs, "series string, run_at timestamp, breached boolean"), path=str(tmp_path / "ro"))
    assert [(x["streak"], x["alert"]) for x in got.orderBy("run_at").collect()] == [(1, False), (2, False), (3, True), (4, True), (0, False)]


def test_first_made_snapshot_stays_whichever_comes_first(spark, tmp_path):
    schema = "region string, target_ts timestamp, horizon string, made_at timestamp, p double"
    parts = [[("A", at(50), "24h", at(9), 3.0), ("A", at(51), "24h", at(5), 1.0)], [("A", at(50), "24h", at(2), 2.0), ("A", at(50), "48h", at(1), 7.0)], [("A", at(50), "24h", at(4), 9.0)]]
    s = so.first_snapshots(files(spark, str(tmp_path / "in"), parts, schema))
    out = str(tmp_path / "out")
    update_log(s, out, str(tmp_path / "state")).awaitTermination()
    got = read_latest(spark, out, s.schema, ["region", "target_ts", "horizon"]).collect()
    assert {(r["target_ts"], r["horizon"]): (r["made_at"], r["p"], r["skipped"]) for r in got} == {
        (at(50), "24h"): (at(2), 2.0, 2), (at(50), "48h"): (at(1), 7.0, 0), (at(51), "24h"): (at(5), 1.0, 0)}


LEDGER = "region string, model string, ts timestamp, predicted double, actual double, lead_hours long, placeholder boolean, captured_at timestamp"


def test_ledger_equals_the_batch_forms_in_any_order(spark, tmp_path):
    rng = random.Random(12)
    records, revisions = [], []
    for region in ("A", "B"):
        for h in range(0, 800, 3):
            actual = 1000.0 + rng.random() if region == "A" else rng.choice([0.0, 3.0, 40.0, 1000.0, 1100.5])
            for m in ("m1", "m2"):
                records.append((region, m, at(h), actual * rng.uniform(0.5, 1.5) + 1, actual, rng.choice([None, 1, 4, 30]), rng.choice([None, True, False]), at(h)))
            if rng.random() < 0.5:
                revisions.append((region, None, at(h), None, rng.choice([actual * 1.2, 5.0, actual + 0.001, 0.0, -4.0]), None, None, at(h + 40)))
            if rng.random() < 0.3:
                revisions.append((region, None, at(h), None, 777.0, None, None, at(h + 20)))
    current = {}
    for r in sorted(revisions, key=lambda r: (r[7], r[4])):
        if r[4] > 0:
            current[r[0], r[2]] = r[4]
    now = F.lit(at(799) + timedelta(minutes=30))
    table = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in records], "region string, model string, ts timestamp, predicted double, actual double, lead_hours long, placeholder boolean")
    graded = drift.regrade(table, spark.createDataFrame([(k[0], k[1], v) for k, v in current.items()], "region string, ts timestamp, actual double"))

    def rounded(df, keys=2):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())

    base = drift.rolling_block(graded, now, max_lead=6)
    want, stats = rounded(base.select(sorted(base.columns))), rounded(drift.regrade_stats(graded, ["region", "model"]))
    for turn in range(2):
        rows = rng.sample(records + revisions, len(records) + len(revisions))
        path = str(tmp_path / f"ledger{turn}")
        run = ledger.regrade_batch(path, 6)
        cuts = [rows[:300], rows[300:310], rows[310:700], rows[700:], revisions[:20]]
        for n, part in enumerate(cuts):
            run(spark.createDataFrame(part, LEDGER), n)
        run(spark.createDataFrame(cuts[-1], LEDGER), len(cuts) - 1)  # replayed
        got = ledger.rolling_sums(spark, path, now, 6)
        assert rounded(got.select(sorted(got.columns))) == want
        assert rounded(ledger.regraded_stats(ledger.read_records(spark, path))) == stats
    assert newest(table, ["region"], "ts", 1).count() == 2
