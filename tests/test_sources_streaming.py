"""File sources, sinks and multi-batch streams."""

import json

import pytest
from helpers import at, series
from pyspark.sql import functions as F

from loadstone.operators import vintage as vt
from loadstone.sources import feeds, files
from loadstone.streaming import operators as so
from loadstone.streaming.sinks import drain, stream_table
from loadstone.streaming.vintage import drop_superseded, fold_batch, live_window, read_vintages, vintage_stream


def test_partitioned_round_trip_prunes_and_missing_table_is_empty(spark, tmp_path):
    df = series(spark, [1, None]).drop("h").withColumn("forecast_mw", F.lit(None).cast("double")).unionByName(
        series(spark, [3], "B").drop("h").withColumn("forecast_mw", F.lit(4.0)))
    path = str(tmp_path / "demand")
    files.write_table(df, path)
    got = files.read_table(spark, path, files.DEMAND, ["B"])
    assert [tuple(r) for r in got.collect()] == [("B", at(0), 3.0, 4.0)]
    assert got.inputFiles() and all("region=" in f for f in got.inputFiles())
    assert "region" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    empty = files.read_table(spark, str(tmp_path / "none"), files.DEMAND)
    assert empty.count() == 0 and empty.columns == ["region", "ts", "demand_mw", "forecast_mw"]


def test_metadata_scan_skips_malformed_files(spark, tmp_path):
    for k, (when, m) in enumerate([("2024-01-01T00:00:00", 4.0), ("2024-02-01T00:00:00", 3.0)]):
        d = tmp_path / "A" / "trees"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"v{k}.meta.json").write_text(json.dumps({"region": "A", "model": "trees", "version": f"v{k}", "trained_at": when, "mape": m}))
    (tmp_path / "A" / "trees" / "bad.meta.json").write_text("{not json")
    (tmp_path / "A" / "trees" / "other.json").write_text("{}")
    raw = files.read_metadata(spark, str(tmp_path))
    assert raw.count() == 2
    assert feeds.latest_metadata(raw).first()["version"] == "v1"
    assert feeds.metadata_history(raw).filter("is_latest").first()["mape"] == 3.0


def test_ticks_from_json_lines(spark, tmp_path):
    p = tmp_path / "ticks.json"
    p.write_text('{"tick": "2024-01-01T00:00:00", "elapsed_s": 5.5, "phases": {"a": {"total_s": 2.0, "n": 3}, "b": {"total_s": 1.0, "n": 1}}}\n{broken\n')
    got = feeds.explode_ticks(files.read_ticks(spark, str(p))).orderBy("phase").collect()
    assert [(r["phase"], r["total_s"], r["n"]) for r in got] == [("a", 2.0, 3), ("b", 1.0, 1)]


def test_csv_export(spark, tmp_path):
    wide = spark.createDataFrame([("A", "m", 1.0, None)], "region string, model string, mape double, mae double")
    files.write_csv(files.metrics_long(wide, ["mape", "mae"]), str(tmp_path / "out"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("A", "m", "mape", "1.0")]


def test_demand_feed_values(spark):
    rows = [("A", "2024-01-01T00", "D", "100"), ("A", "2024-01-01T01", "D", ""), ("A", "2024-01-01T02", "D", "0"), ("A", "2024-01-01T03", "D", "x"),
            ("A", "2024-01-01T04", "D", None), ("A", "2024-01-01T00", "DF", "90"), ("A", "2024-01-01T09", "DF", "5"), ("A", "2024-01-01T05", "D", "NaN")]
    got = feeds.parse_demand(spark.createDataFrame(rows, "region string, period string, type string, value string")).orderBy("ts").collect()
    assert [(r["demand_mw"], r["forecast_mw"]) for r in got] == [(100.0, 90.0)] + [(None, None)] * 5


def test_local_clock_changes(spark):
    from loadstone.functions.timeutil import local_to_utc

    df = spark.sql("SELECT explode(array(timestamp'2024-03-10 02:30:00', timestamp'2024-11-03 01:30:00', timestamp'2024-07-01 12:00:00')) AS t")
    got = [r[0] for r in df.select(local_to_utc("t", "America/New_York")).collect()]
    assert got[:2] == [None, None] and got[2].hour == 16


def test_alert_feed_defaults(spark):
    doc = json.dumps({"features": [{"properties": {"id": "1", "severity": "Severe", "areaDesc": " a ;; b;", "description": "y" * 600, "expires": "2024-01-01T00:00:00+02:00"}}, {"properties": {}}]})
    got = feeds.parse_alerts(spark.createDataFrame([("NY", doc)], "state string, payload string")).orderBy(F.desc("id")).collect()
    assert (got[0]["severity"], got[0]["areas"], len(got[0]["description"]), got[0]["expires"].hour) == ("critical", ["a", "b"], 500, 22)
    assert (got[1]["event"], got[1]["severity"], got[1]["areas"], got[1]["states"]) == ("Unknown", "info", [], ["NY"])


READ = "region string, target_ts timestamp, captured_at timestamp, d double, df double"


def batches(spark, path, *parts, schema):
    """One file per micro-batch, in name order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return stream_table(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_vintage_stream_equals_batch_fold(spark, tmp_path):
    parts = [[("A", at(0), at(1), 100.0, None), ("A", at(1), at(1), 50.0, 50.0)], [("A", at(0), at(2), 100.3, 80.0)], [("A", at(0), at(3), 120.0, 85.0), ("A", at(2), at(3), 70.0, None)]]
    stream = batches(spark, str(tmp_path / "in"), *parts, schema=READ)
    out = str(tmp_path / "table")
    vintage_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    got = read_vintages(spark, out)
    want = vt.vintages(spark.createDataFrame([r for p in parts for r in p], READ))
    cols = ["region", "target_ts", "first_seen_d", "first_seen_df", "captured_at", "last_d", "n_updates", "df_at"]
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert key(got) == key(want)


def test_replayed_batch_changes_nothing_and_other_days_stay(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = [[("A", at(0), at(1), 100.0, None), ("A", at(30), at(31), 5.0, None)], [("A", at(0), at(2), 110.0, 80.0)], [("A", at(0), at(3), 130.0, None)]]
    run = fold_batch(out)
    for n, r in ((0, rows[0]), (1, rows[1]), (1, rows[1]), (2, rows[2])):
        run(spark.createDataFrame(r, READ), n)
    got = {r["target_ts"]: (r["first_seen_d"], r["last_d"], r["n_updates"], r["first_seen_df"]) for r in read_vintages(spark, out).collect()}
    assert got == {at(0): (100.0, 130.0, 2, 80.0), at(30): (5.0, 5.0, 0, None)}
    assert live_window(spark, out, F.lit(at(20 + 720))).count() == 1


def test_unmatched_predictions_come_out_expired(spark, tmp_path):
    schema = "region string, target_ts timestamp, predicted double"
    p = batches(spark, str(tmp_path / "p"), [("A", at(0), 10.0), ("A", at(1), 10.0)], [("A", at(1000), 10.0)], [("A", at(1001), 10.0)], schema=schema)
    a = batches(spark, str(tmp_path / "a"), [("A", at(0), 8.0)], [("A", at(1000), 9.0)], [("A", at(1001), 9.0)], schema="region string, target_ts timestamp, actual double")
    got = {(r["target_ts"], r["state"]) for r in drain(so.resolve(p, a), "resolve-test", mode="append").collect()}
    assert (at(0), "resolved") in got and (at(1), "expired") in got


def test_guard_refuses_to_reseed(spark, tmp_path):
    path, mark = str(tmp_path / "t"), str(tmp_path / "mark")
    run = fold_batch(path, marker=mark)
    run(spark.createDataFrame([], READ), 0)  # nothing to fold, so nothing is marked
    run(spark.createDataFrame([], READ), 0)
    batches = [spark.createDataFrame([("A", at(0), at(1 + k), 100.0 + k, None)], READ) for k in range(3)]
    run(batches[0], 1)
    run(batches[1], 2)
    run(batches[1], 2)  # a replay
    assert [(r["first_seen_d"], r["last_d"]) for r in read_vintages(spark, path).collect()] == [(100.0, 101.0)]
    missing = fold_batch(str(tmp_path / "gone"), marker=mark)
    with pytest.raises(RuntimeError, match="refusing to reseed"):
        missing(batches[2], 3)


def test_vintage_table_refuses_a_lost_checkpoint_and_drops_old_versions(spark, tmp_path):
    out = str(tmp_path / "guarded")
    run = fold_batch(out)
    batches = [spark.createDataFrame([("A", at(0), at(1 + k), 100.0 + k, None)], READ) for k in range(4)]
    for k, b in enumerate(batches):
        run(b, k)
    run(batches[3], 3)  # a replay is no loss
    want = read_vintages(spark, out).collect()
    assert (want[0]["first_seen_d"], want[0]["last_d"]) == (100.0, 103.0)
    with pytest.raises(RuntimeError):
        run(batches[0], 0)
    assert drop_superseded(spark, out) == 2
    assert read_vintages(spark, out).collect() == want
    assert drop_superseded(spark, out) == 0


def test_day_ahead_join_collapses_repeated_records(spark):
    rows = [("A", "2024-01-01T00", "D", "5"), ("A", "2024-01-01T00", "D", "7"), ("A", "2024-01-01T00", "DF", "3"), ("A", "2024-01-01T00", "DF", "4")]
    records = spark.createDataFrame(rows, "region string, period string, type string, value string")
    assert [tuple(r)[2:] for r in feeds.join_day_ahead(records).collect()] == [tuple(r)[2:] for r in feeds.parse_demand(records).collect()] == [(7.0, 4.0)]


def test_malformed_documents_are_counted(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    good = {"region": "A", "model": "m", "version": "1", "trained_at": "2024-01-01T00:00:00", "mape": 2.0}
    for k, text in enumerate([json.dumps(good, indent=1), "{broken", json.dumps({**good, "model": None}), ""]):
        (folder / f"{k}.meta.json").write_text(text)
    (folder / "notes.json").write_text("{}")
    rows = files.scan_metadata(spark, str(tmp_path))
    assert [(r["region"], r["mape"]) for r in files.accepted(rows).collect()] == [("A", 2.0)]
    assert {(r["reason"], r["n"]) for r in files.rejections(rows).collect()} >= {("unreadable", 1), ("missing model", 1)}
    (tmp_path / "ticks").mkdir()
    (tmp_path / "ticks" / "log").write_text('{"tick": "2024-01-01T00:00:00", "elapsed_s": 1.5, "phases": {"x": {"total_s": 1.0, "n": 2}}}\nnot json\n{"tick": null}\n')
    ticks = files.scan_ticks(spark, str(tmp_path / "ticks"))
    assert feeds.explode_ticks(files.accepted(ticks)).collect()[0]["total_s"] == 1.0
    assert sorted(tuple(r)[:2] for r in files.rejections(ticks).collect()) == [("missing tick", 1), ("unreadable", 1)]


def test_dead_letters_of_a_replayed_batch(spark, tmp_path):
    from loadstone.streaming.sinks import dead_letters

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text('{"horizon": "24h", "target_ts": "2024-01-02T00:00:00"}\n{"horizon": "24h", "target_ts": "2023-01-02T00:00:00"}\n{"horizon"\n{"horizon": "48h"}\n')
    for _ in range(2):
        rows = files.json_rows(spark.readStream, "horizon STRING, target_ts TIMESTAMP", ["target_ts"], str(tmp_path / "in"))
        q = dead_letters(so.with_expiry(rows, F.lit(at(48))), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "good")).count() == 1
    assert sorted(r["rejected"] for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()) == ["expired", "missing target_ts", "unreadable"]
