"""The engine's vocabulary in SQL text: scalar and table functions of a session, as SQL-language functions.

They are expanded by the optimizer like any expression or lateral subquery, so filters and pruning pass through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from loadstone.operators.scenario import AXES


def _axis(name: str) -> str:
    return ", ".join(f"({v}D)" for v in AXES[name])


SCALARS = {
    "ls_ape(actual DOUBLE, predicted DOUBLE) RETURNS DOUBLE": "CASE WHEN actual <> 0 THEN abs(actual - predicted) / abs(actual) * 100 END",
    "ls_smape(actual DOUBLE, predicted DOUBLE) RETURNS DOUBLE": "CASE WHEN abs(actual) + abs(predicted) > 0 THEN 200 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END",
    "ls_wape(error_sum DOUBLE, actual_sum DOUBLE) RETURNS DOUBLE": "CASE WHEN actual_sum > 0 THEN error_sum / actual_sum * 100 END",
    "ls_skill(error DOUBLE, reference DOUBLE) RETURNS DOUBLE": "CASE WHEN reference <> 0 THEN round(1 - error / reference, 4) END",
    "ls_lead_hours(later TIMESTAMP, earlier TIMESTAMP) RETURNS DOUBLE": "(unix_micros(later) - unix_micros(earlier)) / 3.6e9D",
    "ls_cdd(temp_f DOUBLE) RETURNS DOUBLE": "greatest(temp_f - 65D, 0D)",
    "ls_hdd(temp_f DOUBLE) RETURNS DOUBLE": "greatest(65D - temp_f, 0D)",
}
TABLES = {
    "ls_hour_spine(first TIMESTAMP, last TIMESTAMP) RETURNS TABLE (ts TIMESTAMP)": "SELECT explode(sequence(first, last, INTERVAL 1 HOUR))",
    "ls_calendar(first TIMESTAMP, last TIMESTAMP) RETURNS TABLE (ts TIMESTAMP, hour INT, dow INT, month INT, doy INT, is_weekend BOOLEAN)":
        "SELECT t, hour(t), weekday(t), month(t), dayofyear(t), weekday(t) >= 5 FROM (SELECT explode(sequence(first, last, INTERVAL 1 HOUR)) AS t)",
    "ls_splits(n BIGINT, windows INT, holdout INT, min_train INT, stride INT) RETURNS TABLE (fold INT, test_start BIGINT, test_end BIGINT)":
        "SELECT f, n - f * stride - holdout, n - f * stride FROM (SELECT explode(sequence(0, windows - 1)) AS f) WHERE n - f * stride - holdout >= min_train",
    "ls_scenario_axes() RETURNS TABLE (temp_f DOUBLE, wind_mph DOUBLE, solar_wm2 DOUBLE)":
        f"SELECT t, w, s FROM (VALUES {_axis('temp_f')}) AS a(t) CROSS JOIN (VALUES {_axis('wind_mph')}) AS b(w) CROSS JOIN (VALUES {_axis('solar_wm2')}) AS c(s)",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, for as long as it lasts."""
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
