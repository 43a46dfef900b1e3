"""Vintage and benchmark queries."""

from pyspark.sql import functions as F

from loadstone.operators import benchmark as bm
from loadstone.operators import metrics as mt
from loadstone.operators import vintage as vt
from loadstone.operators.cleaning import real_positive
from loadstone.operators.series import lead_hours
from loadstone.plans import frames as fr
from loadstone.plans.registry import query
from loadstone.session import stored


def paired(spark, sf):
    return bm.pair_hours(fr.vintage(spark, sf), fr.our_predictions(spark, sf), ["lead"])


@query("d1_vintage_fold", "vintage", "SELECT * FROM vintage", d="first_seen_d first_seen_df last_d")
def vintage_fold(spark, sf):
    return fr.vintage(spark, sf)


@query("a25_vintage_summary", "vint", """
SELECT region, count(*) AS n_records, count(*) FILTER (placeholder) AS n_placeholder, count(*) FILTER (n_updates > 0) AS n_revised,
  avg(revision_pct) AS mean_revision_pct, max(revision_pct) AS max_revision_pct, max(target_ts) AS newest_hour,
  arg_max(placeholder, target_ts) AS newest_was_placeholder FROM vint GROUP BY region""", d="mean_revision_pct max_revision_pct")
def vintage_summary(spark, sf):
    return vt.summary(fr.vintage(spark, sf))


@query("a26_revision_class", "classes", "SELECT * FROM classes", d="fresh_revised_fraction mean_fresh_revision_pct")
def revision_class(spark, sf):
    return vt.classify(fr.vintage(spark, sf))


@query("w11_feed_gaps", "gaps", "SELECT * FROM gaps", d="stale_hours longest_gap_hours")
def feed_gaps(spark, sf):
    return vt.feed_gaps(fr.vintage(spark, sf))


def score(spark, sf):
    columns = ["region", "target_ts", "first_seen_d", "first_seen_df", "captured_at", "last_d", "n_updates", "df_at"]
    return vt.scoreability(stored(fr.vintage(spark, sf).select(*columns), "vintage"))


@query("a27_scoreability", "score", "SELECT * FROM score",
       d="df_coverage df_asissued_coverage placeholder_pct stale_hours longest_gap_hours absent_hours_bias_pct")
def scoreability(spark, sf):
    return score(spark, sf)


@query("a28_absent_hour_bias", "score", "SELECT region, n_absent_hours AS n_absent, absent_hours_bias_pct FROM score", d="absent_hours_bias_pct")
def absent_bias(spark, sf):
    return vt.absent_bias(fr.vintage(spark, sf))


@query("a29_official_quality", "vint", """
SELECT region, count(*) AS n, CASE WHEN count(*) >= 50 THEN quantile_cont(abs(first_seen_df - last_d) / last_d * 100, 0.5) END AS median_ape
FROM vint WHERE last_d > 0 AND first_seen_df IS NOT NULL AND NOT placeholder AND abs(last_d - first_seen_df) >= 0.01 AND df_lag <= 3 GROUP BY region""", d="median_ape")
def official_quality(spark, sf):
    return vt.official_quality(fr.vintage(spark, sf))


@query("g13_capture_lag", "vint", "SELECT region, target_ts, lag AS capture_lag, df_lag AS df_capture_lag FROM vint", d="capture_lag df_capture_lag")
def capture_lag(spark, sf):
    return fr.vintage(spark, sf).select("region", "target_ts", vt.capture_lag().alias("capture_lag"), vt.df_capture_lag().alias("df_capture_lag"))


@query("j6_two_arm_pairing", "pairs", "SELECT * EXCLUDE df_lag FROM pairs", d="actual official official_revised ours")
def pairing(spark, sf):
    return paired(spark, sf)


REASONS = ", ".join(f"count(*) FILTER (drop_reason = '{r}') AS {r}" for r in bm.DROP_REASONS)


@query("j6_drop_counts", "pairs", f"SELECT region, count(*) FILTER (drop_reason IS NULL) AS paired, {REASONS} FROM pairs GROUP BY region")
def drop_counts(spark, sf):
    return bm.drop_counts(paired(spark, sf))


@query("a19_arm_scorecard", "arms", "SELECT * FROM arms", d="mape median_ape mae wape")
def arm_scorecard(spark, sf):
    return bm.arm_scores(stored(paired(spark, sf), "pairs"), ["region", "lead"])


@query("a20_fleet_macro_average", "arms", """
SELECT arm, lead, avg(mape) AS mape, avg(wape) AS wape, sum(n) AS n, count(*) AS n_regions FROM arms WHERE lead IS NOT NULL GROUP BY arm, lead""", d="mape wape", i="n")
def macro_average(spark, sf):
    s = bm.arm_scores(paired(spark, sf).filter("lead IS NOT NULL"), ["region", "lead"])
    return mt.macro_average(s, ["arm", "lead"], ["mape", "wape"])


PAYLOAD = """payload AS (SELECT region, lead, n, n >= 200 AS scoreable, {cols},
  CASE WHEN n >= 200 THEN official_mape - ours_mape END AS delta_mape, CASE WHEN n >= 200 THEN official_wape - ours_wape END AS delta_wape,
  CASE WHEN n >= 200 THEN official_median_ape - ours_median_ape END AS delta_median_ape, CASE WHEN n >= 200 THEN official_revised_mape - ours_mape END AS delta_mape_vs_revised,
  CASE WHEN n >= 200 THEN CASE WHEN ours_mape < official_mape THEN 'ours' ELSE 'official' END END AS winner,
  CASE WHEN n >= 200 THEN CASE WHEN ours_mape < official_revised_mape THEN 'ours' ELSE 'official' END END AS winner_vs_revised,
  CASE WHEN n >= 200 THEN 'observed' END AS lead_basis, CASE WHEN n >= 200 AND lead = '48h' THEN region <> 'R1' END AS conservative
FROM (SELECT region, lead, count(*) FILTER (drop_reason IS NULL) AS n FROM pairs WHERE lead IS NOT NULL GROUP BY ALL) LEFT JOIN (SELECT region, lead, {pivot} FROM arms GROUP BY ALL) w USING (region, lead))"""
COLS = [(a, m) for a in bm.ARMS for m in ("mape", "wape", "median_ape")]
PAYLOAD = PAYLOAD.format(
    cols=", ".join(f"CASE WHEN n >= 200 THEN w.{a}_{m} END AS {a}_{m}" for a, m in COLS),
    pivot=", ".join(f"max({m}) FILTER (arm = '{a}') AS {a}_{m}" for a, m in COLS))
PAYLOAD_D = " ".join([f"{a}_{m}" for a, m in COLS] + ["delta_mape", "delta_wape", "delta_median_ape", "delta_mape_vs_revised"])


def payload(spark, sf):
    p = stored(paired(spark, sf), "pairs")
    lead = p.select("region", "lead").filter("lead IS NOT NULL").distinct().withColumn(
        "observed_lead_h", F.when(F.col("region") == "R1", 40.0).otherwise(47.8))
    return bm.lead_payload(p, lead)


@query("a30_benchmark_by_lead", "arms", "WITH " + PAYLOAD + " SELECT * FROM payload", d=PAYLOAD_D)
def benchmark_by_lead(spark, sf):
    return payload(spark, sf)


@query("a21_fleet_rollup", "arms", "WITH " + PAYLOAD + """
SELECT lead, count(*) FILTER (scoreable) AS n_scoreable, count(*) FILTER (NOT scoreable) AS n_excluded, count(*) FILTER (scoreable AND region <> 'R0') AS n,
  count(*) FILTER (scoreable AND region <> 'R0' AND winner = 'ours') AS wins, count(*) FILTER (scoreable AND region <> 'R0' AND winner <> 'ours') AS losses,
  min(ours_mape) FILTER (region <> 'R0') AS ours_min, max(ours_mape) FILTER (region <> 'R0') AS ours_max, min(official_mape) FILTER (region <> 'R0') AS official_min,
  max(official_mape) FILTER (region <> 'R0') AS official_max, count(*) FILTER (scoreable AND region = 'R0') AS n_isolated,
  quantile_cont(ours_mape, 0.5) FILTER (region <> 'R0') AS median_ours_mape, quantile_cont(official_mape, 0.5) FILTER (region <> 'R0') AS median_official_mape,
  ours_max / ours_min AS ours_ratio, official_max / official_min AS official_ratio FROM payload GROUP BY lead""",
       d="ours_min ours_max official_min official_max median_ours_mape median_official_mape ours_ratio official_ratio")
def fleet_rollup(spark, sf):
    return bm.fleet_rollup(payload(spark, sf), ["R0"], ["lead"])


@query("a51_metric_robustness", "arms", "WITH " + PAYLOAD + """,
m AS (SELECT lead, max(ours_mape) / min(ours_mape) AS ours_spread, max(official_mape) / min(official_mape) AS official_spread,
  [quantile_cont(ours_mape, 0.5), quantile_cont(ours_median_ape, 0.5), quantile_cont(ours_wape, 0.5)] AS o,
  [quantile_cont(official_mape, 0.5), quantile_cont(official_median_ape, 0.5), quantile_cont(official_wape, 0.5)] AS f FROM payload WHERE scoreable GROUP BY lead)
SELECT lead, ours_spread, official_spread, metric, ours, official, CASE WHEN ours = official THEN 'tie' WHEN (ours < official) = (o[1] < f[1]) THEN 'same' ELSE 'flips' END AS verdict
FROM (SELECT *, unnest(['mape', 'median_ape', 'wape']) AS metric, unnest(o) AS ours, unnest(f) AS official FROM m)""", d="ours_spread official_spread ours official")
def metric_robustness(spark, sf):
    return bm.metric_robustness(payload(spark, sf), ["lead"])


@query("a31_stale_capture_impact", "pairs vint", """
SELECT region, lead, n_all - n_fresh AS n_hours_excluded, o - o_fresh AS ours_mape_shift_pts, f - f_fresh AS official_mape_shift_pts FROM (
SELECT region, lead, count(*) AS n_all, count(*) FILTER (df_lag <= 3) AS n_fresh, avg(abs(actual - ours) / actual * 100) AS o, avg(abs(actual - official) / actual * 100) AS f,
  avg(abs(actual - ours) / actual * 100) FILTER (df_lag <= 3) AS o_fresh, avg(abs(actual - official) / actual * 100) FILTER (df_lag <= 3) AS f_fresh
FROM pairs JOIN (SELECT region, target_ts, placeholder FROM vint) USING (region, target_ts)
WHERE official IS NOT NULL AND actual > 0 AND abs(actual - official) >= 0.01 AND NOT placeholder AND ours IS NOT NULL GROUP BY ALL)
WHERE n_all > n_fresh AND n_all >= 200""", d="ours_mape_shift_pts official_mape_shift_pts")
def stale_impact(spark, sf):
    return bm.stale_impact(fr.vintage(spark, sf), fr.our_predictions(spark, sf))


@query("b24_scoreability_alerts", "score", """
SELECT 'scoreability_drop' AS event, NULL::VARCHAR AS region, CAST(count(*) FILTER (scoreable) AS DOUBLE) AS value FROM score HAVING count(*) FILTER (scoreable) < 40
UNION ALL SELECT 'gap_at_risk', region, longest_gap_hours FROM score WHERE scoreable AND longest_gap_hours >= 120""", d="value")
def scoreability_alerts(spark, sf):
    return bm.scoreability_alerts(score(spark, sf))


@query("a52_drop_reason_audit", "vint", """
SELECT region, count(*) FILTER (reason = 'no_df') AS no_df, count(*) FILTER (reason = 'stale_capture') AS stale_capture, count(*) FILTER (reason = 'unsettled') AS unsettled,
  count(*) FILTER (reason = 'unresolved_stub') AS unresolved_stub, count(*) FILTER (reason = 'first_seen_placeholder') AS first_seen_placeholder,
  count(*) FILTER (reason = 'ok') AS would_pair, count(*) FILTER (back <= 48 AND NOT placeholder AND df_lag <= 3) AS edge_usable, greatest(0, 200 - count(*) FILTER (reason = 'ok')) AS short_by
FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY target_ts DESC) AS back, CASE WHEN first_seen_df IS NULL THEN 'no_df' WHEN df_lag > 3 THEN 'stale_capture'
  WHEN last_d IS NULL OR last_d <= 0 THEN 'unsettled' WHEN abs(last_d - first_seen_df) < 0.01 THEN 'unresolved_stub' WHEN placeholder THEN 'first_seen_placeholder' ELSE 'ok' END AS reason FROM vint)
GROUP BY region""", i="short_by")
def drop_audit(spark, sf):
    return bm.drop_audit(fr.vintage(spark, sf))


@query("a53_forecast_revision_probe", "vint our_predictions", """
SELECT region, count(*) AS n_compared, count(*) FILTER (delta >= 0.5) / count(*) * 100 AS revised_pct,
  coalesce(max(delta / greatest(abs(revised_df), 1) * 100) FILTER (delta >= 0.5), 0) AS max_revision_pct,
  quantile_cont(CASE WHEN graded THEN abs(first_seen_df - last_d) / last_d * 100 END, 0.5) AS as_issued_pct,
  quantile_cont(CASE WHEN graded THEN abs(revised_df - last_d) / last_d * 100 END, 0.5) AS as_revised_pct, as_issued_pct - as_revised_pct AS median_ape_shift_pts
FROM (SELECT *, abs(first_seen_df - revised_df) AS delta, last_d > 0 AND NOT placeholder AND abs(last_d - first_seen_df) >= 0.01 AS graded
  FROM vint JOIN our_predictions USING (region, target_ts) WHERE first_seen_df IS NOT NULL AND revised_df IS NOT NULL)
GROUP BY region HAVING count(*) >= 50 AND count(*) FILTER (graded) >= 50""", d="revised_pct max_revision_pct as_issued_pct as_revised_pct median_ape_shift_pts")
def revision_probe(spark, sf):
    current = fr.our_predictions(spark, sf).select("region", "target_ts", F.col("revised_df").alias("current_df"))
    return vt.revision_probe(fr.vintage(spark, sf), current)


@query("a54_realised_lead", "readings", """
SELECT region, avg(24 - lag) AS realised_24h, avg(48 - lag) AS realised_48h, min(24 - lag) AS worst_24h
FROM (SELECT region, epoch(captured_at - target_ts) / 3600 AS lag FROM readings) GROUP BY region""", d="realised_24h realised_48h worst_24h")
def realised_lead(spark, sf):
    """Origin plus the nominal lead, minus when the forecast was made."""
    r = fr.readings(spark, sf)
    def lead(n):
        return lead_hours(F.col("target_ts") + F.make_dt_interval(F.lit(0), F.lit(n)), "captured_at")
    return r.groupBy("region").agg(F.avg(lead(24)).alias("realised_24h"), F.avg(lead(48)).alias("realised_48h"), F.min(lead(24)).alias("worst_24h"))


@query("a42_anchor_proxy_by_class", "vint classes", """
SELECT revision_class, count(*) FILTER (NOT placeholder) AS n_contested, count(*) FILTER (placeholder) AS placeholder_ties,
  avg(prod) FILTER (NOT placeholder) AS prod_mean, avg(dfe) FILTER (NOT placeholder) AS df_mean,
  quantile_cont(prod, 0.5) FILTER (NOT placeholder) AS prod_median, quantile_cont(dfe, 0.5) FILTER (NOT placeholder) AS df_median,
  count(*) FILTER (NOT placeholder AND dfe < prod) / count(*) FILTER (NOT placeholder) AS win_rate, prod_mean - df_mean AS margin,
  CASE WHEN revision_class IN ('clean', 'unknown') THEN 'never' WHEN win_rate > 0.6 AND margin >= 2.0 THEN CASE WHEN revision_class = 'bulk' THEN 'review' ELSE 'condition' END ELSE 'skip' END AS verdict
FROM (SELECT revision_class, placeholder, abs(first_seen_d - last_d) / last_d * 100 AS prod, abs(first_seen_df - last_d) / last_d * 100 AS dfe
  FROM vint JOIN (SELECT region, revision_class FROM classes) USING (region) WHERE lag <= 3 AND last_d > 0 AND first_seen_df IS NOT NULL)
GROUP BY revision_class""", d="prod_mean df_mean prod_median df_median win_rate margin")
def anchor_proxy(spark, sf):
    v = fr.vintage(spark, sf)
    return bm.anchor_proxy(v, vt.classify(v))


@query("p4_settled_positive", "vintage", "SELECT region, count(*) FILTER (last_d > 2000) AS n FROM vintage GROUP BY region")
def settled_positive(spark, sf):
    return fr.vintage(spark, sf).groupBy("region").agg(F.count_if(real_positive(F.col("last_d") - 2000)).alias("n"))
