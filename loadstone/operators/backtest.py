"""Rolling-origin folds, walk-forward backtests and calibrated intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadstone.operators import metrics as mt
from loadstone.operators.quantiles import percentiles
from loadstone.operators.series import hour_number, newest_counted, previous, running

# Fixed values.
MAX_FOLDS = 5
MIN_TRAIN_ROWS = 720
SNAPSHOT_COVERAGE = 0.8
ANCHOR_HORIZONS = (24, 168, 720)
REFRESH_DAYS = 7


def rolling_splits(sizes: DataFrame, n_windows: int, holdout: int, min_train: int, stride: int | None = None) -> DataFrame:
    """Newest-first folds per series: (fold, test_start, test_end) row positions.

    Stops at the first fold whose training part would be too short.
    """
    step = holdout if stride is None else stride
    f = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("fold"))
    end = F.col("n") - F.col("fold") * step
    return f.select("*", (end - holdout).alias("test_start"), end.alias("test_end")).filter(F.col("test_start") >= min_train)


def walk_forward_folds(sizes: DataFrame, horizon: int, min_train: int = MIN_TRAIN_ROWS, max_folds: int = MAX_FOLDS) -> DataFrame:
    """Oldest-first expanding folds, at most five, none if the series is too short."""
    count = F.least(F.lit(max_folds), F.greatest(F.lit(1), F.floor((F.col("n") - min_train) / horizon))).cast("int")
    f = sizes.filter(F.col("n") >= min_train + horizon).select("*", F.explode(F.sequence(F.lit(1), count)).alias("fold"), count.alias("n_folds"))
    start = F.col("n") - (F.col("n_folds") - F.col("fold") + 1) * horizon
    return f.select("*", start.alias("test_start"), (start + horizon).alias("test_end")).filter(F.col("test_start") >= min_train)


def fold_rows(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = ("region",), pos: str = "pos") -> DataFrame:
    """Test rows of each fold. Folds of a series are few and disjoint, so each row
    meets at most the folds of its own series."""
    return rows.join(folds.drop("n"), list(keys)).filter((F.col(pos) >= F.col("test_start")) & (F.col(pos) < F.col("test_end")))


def naive_arm(rows: DataFrame, folds: DataFrame, lag: int = 24, keys: Sequence[str] = ("region",), v: str = "demand_mw") -> DataFrame:
    """Seasonal-naive prediction of every test row from the rows before its fold."""
    keys = list(keys)
    test = fold_rows(rows, folds, keys).withColumn("lead", F.col("pos") - F.col("test_start") + 1)
    back = F.col("pos") - lag * F.ceil(F.col("lead") / lag)
    src = rows.select(*keys, F.col("pos").alias("_src"), F.col(v).alias("predicted"))
    return test.withColumn("_src", back).join(src, [*keys, "_src"]).drop("_src")


def train_climatology(rows: DataFrame, folds: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",), ts: str = "ts") -> DataFrame:
    """Test rows with ``clim_{col}``: the (weekday, hour) mean of the fold's training
    rows, falling back to the hour, then to the whole training mean.

    Every row is counted once in its segment between fold starts and the segments
    are added up per fold, so folds do not multiply the rows.
    """
    keys = list(keys)
    marks = folds.groupBy(*keys).agg(F.sort_array(F.collect_list("test_start")).alias("_marks"))
    seg = F.size(F.filter("_marks", lambda m: m <= F.col("pos")))
    cell = rows.join(marks, keys).select("*", seg.alias("_seg"), F.weekday(ts).alias("_dow"), F.hour(ts).alias("_hour"))
    parts = [e for c in cols for e in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_c_{c}"))]
    sums = cell.groupBy(*keys, "_seg", "_dow", "_hour").agg(*parts)
    f = folds.join(marks, keys).withColumn("_upto", F.array_position("_marks", F.col("test_start")))
    train = sums.join(f.select(*keys, "fold", "_upto"), keys).filter(F.col("_seg") < F.col("_upto"))
    # At most 168 cells a fold: its three levels of means travel as one array of the week's hours.
    k, names = [*keys, "fold"], [f"_{p}_{c}" for c in cols for p in "sc"]
    cells = train.groupBy(*k, "_dow", "_hour").agg(*[F.sum(n).alias(n) for n in names]).groupBy(*k).agg(
        F.collect_list(F.struct((F.col("_dow") * 24 + F.col("_hour")).alias("at"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])).alias("_cells"))

    def mean(c, keep):
        def total(part):
            return F.aggregate(F.filter("_cells", keep), F.lit(0.0), lambda acc, e: acc + e[f"_{part}_{c}"])

        return F.try_divide(total("s"), total("c"))

    def week(c):
        return F.transform(F.sequence(F.lit(0), F.lit(167)), lambda i: F.coalesce(
            mean(c, lambda e: e["at"] == i), mean(c, lambda e: e["at"] % 24 == i % 24), mean(c, lambda e: F.lit(True))))

    means = cells.select(*k, *[week(c).alias(f"_m_{c}") for c in cols])
    test = fold_rows(rows, folds.join(means, k, "left"), keys)
    at = F.weekday(ts) * 24 + F.hour(ts)
    return test.select(*[c for c in test.columns if not c.startswith("_m_")], *[F.get(f"_m_{c}", at).alias(f"clim_{c}") for c in cols])


def climatology_arm(rows: DataFrame, folds: DataFrame, keys: Sequence[str] = ("region",), v: str = "demand_mw", ts: str = "ts") -> DataFrame:
    return train_climatology(rows, folds, [v], keys, ts).withColumnRenamed(f"clim_{v}", "predicted")


def fold_exogenous(rows: DataFrame, folds: DataFrame, archived: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("region",), ts: str = "ts",
                   min_coverage: float = SNAPSHOT_COVERAGE) -> DataFrame:
    """Archived forecast weather for a fold if enough of its hours are complete.

    Its holes take the neighbouring hour of the fold (a fold has as many rows as
    its horizon); other folds use the training climatology.
    """
    keys = list(keys)
    snap = archived.select(*keys, ts, *[F.col(c).alias(f"_a_{c}") for c in cols])
    j = train_climatology(rows, folds, cols, keys, ts).join(snap, [*keys, ts], "left")
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(f"_a_{c}").isNotNull()
    fold = Window.partitionBy(*keys, "fold")
    use = F.avg(whole.cast("double")).over(fold) >= min_coverage
    back, ahead = fold.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0), fold.orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return j.select(*keys, "fold", ts, F.when(use, "archived forecast snapshot").otherwise("climatology/naive baseline").alias("source"),
                    *[F.when(use, F.coalesce(F.last(f"_a_{c}", True).over(back), F.first(f"_a_{c}", True).over(ahead))).otherwise(F.col(f"clim_{c}")).alias(c) for c in cols])


def calibrated(predictions: DataFrame, keys: Sequence[str], horizon: int, ts: str = "ts", low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Predictions with the empirical band of their newest residuals."""
    keys = list(keys)
    n = max(horizon * 5, 120)
    recent = newest_counted(predictions, keys, hour_number(ts), n)
    q = mt.error_quantiles(recent, keys, low, high)
    return predictions.join(q, keys).select(
        *predictions.columns, (F.col("predicted") + F.col("lower_error")).alias("lower"), (F.col("predicted") + F.col("upper_error")).alias("upper"), "sample_size")


def backtest_summary(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    inside = (F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))
    return predictions.groupBy(*keys).agg(
        mt.mape().alias("mape"), mt.rmse().alias("rmse"), mt.mae().alias("mae"), mt.r2().alias("r2"),
        F.avg(inside.cast("double")).alias("coverage"), F.count_distinct("fold").alias("num_folds"), F.count("*").alias("n"))


def interval_anchors(residuals: DataFrame, keys: Sequence[str], order: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Error quantiles of the newest residuals per horizon, where enough exist.

    ``residuals`` holds key, horizon, the order column (a time) and residual.
    """
    keys = [*keys, "horizon"]
    tail = newest_counted(residuals, keys, hour_number(order), F.greatest(F.col("horizon") * 5, F.lit(120)))
    n = residuals.groupBy(*keys).agg(F.count("residual").alias("n_all"))
    q = percentiles(tail, keys, {"lower_error": (F.col("residual"), low), "upper_error": (F.col("residual"), high)})
    size = tail.groupBy(*keys).agg(F.count("residual").alias("sample_size"))
    return q.join(n, keys).join(size, keys).filter(F.col("n_all") >= F.greatest(F.lit(24), F.floor(F.col("horizon") / 2))).select(
        *keys, F.greatest(F.lit(1), F.floor(F.col("horizon") / 2)).alias("effective_lead"), "lower_error", "upper_error", "sample_size")


def _interp(lead: Column, anchors: Column, field: str) -> Column:
    """Piecewise-linear through sorted anchors, flat outside."""
    below = F.try_element_at(F.filter(anchors, lambda a: a["lead"] <= lead), F.lit(-1))
    above = F.try_element_at(F.filter(anchors, lambda a: a["lead"] >= lead), F.lit(1))
    t = (lead - below["lead"]) / (above["lead"] - below["lead"])
    return F.when(below.isNull(), above[field]).when(above.isNull(), below[field]).when(below["lead"] == above["lead"], below[field]).otherwise(
        below[field] + (above[field] - below[field]) * t)


def widening_interval(forecast: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Band that never narrows with the lead, from two or more anchors.

    The anchors of a series are at most the fixed horizons, so they travel as one
    small array per series.
    """
    keys = list(keys)
    arr = anchors.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col("effective_lead").cast("double").alias("lead"), F.col("lower_error").alias("lo"), F.col("upper_error").alias("up")))).alias("_a")).filter(F.size("_a") >= 2)
    x = forecast.join(arr, keys)
    lead = F.col("lead_hours").cast("double")
    x = x.withColumn("_lo", _interp(lead, F.col("_a"), "lo")).withColumn("_up", _interp(lead, F.col("_a"), "up")).drop("_a")
    x = running(x, keys, "lead_hours", {"lo_err": ("min", F.col("_lo")), "up_err": ("max", F.col("_up"))})
    lower = F.greatest(F.col("predicted") + F.col("lo_err"), F.lit(0.0))
    return x.select(*forecast.columns, lower.alias("lower"), F.greatest(F.col("predicted") + F.col("up_err"), lower).alias("upper"))


def indicative_half_width(horizon: Column) -> Column:
    """Band half-width when nothing is calibrated: 3, 6 or 10 percent."""
    return F.when(horizon <= 24, 0.03).when(horizon <= 168, 0.06).otherwise(0.10)


def bottom_up(components: DataFrame, direct: DataFrame, keys: Sequence[str] = ("window_no",), ts: str = "ts") -> DataFrame:
    """Sum of component forecasts against one direct forecast, both per window."""
    total = components.groupBy(*keys, ts).agg(F.sum("predicted").alias("bottom_up"), F.sum("actual").alias("actual"))
    j = total.join(direct.select(*keys, ts, F.col("predicted").alias("top_down")), [*keys, ts])
    return j.groupBy(*keys).agg(
        mt.wape("actual", "bottom_up").alias("wape_bottom_up"), mt.wape("actual", "top_down").alias("wape_top_down"),
        mt.bias_pct("actual", "bottom_up").alias("bias_bottom_up"), mt.bias_pct("actual", "top_down").alias("bias_top_down"), F.count("*").alias("n"))


def bootstrap_mean(df: DataFrame, keys: Sequence[str], value: str, row_id: str, draws: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean from Poisson resamples.

    Each row draws its own count per resample from a hash of its id and the draw. All
    draws of a row are one array, and a draw is a pair of sums of one partial aggregate:
    rows are neither copied per draw nor shuffled, only ``draws`` pairs a key and task are.
    Rows without a value take no part; a key without any value has a null mean and interval.
    """
    # Poisson(1) distribution function, fixed values.
    cdf = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)

    def uniform(b):
        seed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(row_id), b)), 1, 8), 16, 10).cast("long")
        return (F.pmod(seed, F.lit(1_000_003)) + 0.5) / 1_000_003

    # Two steps, so that a draw is hashed once and not once a comparison.
    uniforms = F.transform(F.sequence(F.lit(1), F.lit(draws)), uniform)
    drawn = F.when(F.col(value).isNotNull(), F.transform(uniforms, lambda u: sum(((u > c).cast("int") for c in cdf), F.lit(0))))
    x = df.select(*keys, F.col(value).alias("_v"), drawn.alias("_k"))
    sums = [e for b in range(draws) for e in (F.sum(F.col("_v") * F.get("_k", F.lit(b))).alias(f"_s{b}"), F.sum(F.get("_k", F.lit(b))).alias(f"_c{b}"))]
    g = x.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"), *sums)
    means = F.array_sort(F.array_compact(F.array(*[F.try_divide(f"_s{b}", f"_c{b}") for b in range(draws)])))
    m = g.select(*keys, "mean", "n", means.alias("_m"))

    def quantile(q):
        at = (F.size("_m") - 1) * F.lit(q)
        below, above = F.get("_m", F.floor(at).cast("int")), F.get("_m", F.ceil(at).cast("int"))
        return below + (above - below) * (at - F.floor(at))

    return m.select(*keys, "mean", "n", quantile(low).alias("ci_low"), quantile(high).alias("ci_high"))


def binned_cells(df: DataFrame, col: str, bins: Sequence[tuple], delta: str = "delta") -> DataFrame:
    """Mean, median, count and win rate of a delta by range bins."""
    label = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(bins)):
        label = F.when((F.col(col) >= lo) & (F.col(col) <= hi), name).otherwise(label)
    x = df.withColumn("bin", label).filter("bin IS NOT NULL")
    g = x.groupBy("bin").agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), F.avg((F.col(delta) > 0).cast("double")).alias("win_rate"))
    return g.join(percentiles(x, ["bin"], {"median": (F.col(delta), 0.5)}), "bin")


def recompute_cadence(runs: DataFrame, refresh_days: int = REFRESH_DAYS) -> DataFrame:
    """Times at which anything was recomputed, their days since the last one, and whether that was too soon.

    ``runs`` holds run_at and recomputed (number of regions). A day of slack is left for the scheduler.
    """
    times = runs.filter("recomputed > 0 AND run_at IS NOT NULL").select("run_at").distinct().withColumn("_s", F.unix_micros("run_at"))
    gaps = previous(times, [], "_s", {"_before": "_s"}, 4096 * 86_400_000_000)
    age = (F.col("_s") - F.col("_before")) / 8.64e10
    return gaps.select("run_at", age.alias("age_days"), F.coalesce(age < refresh_days - 1, F.lit(False)).alias("unexpected"))
