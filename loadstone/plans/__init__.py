"""Queries over the driver's tables; importing the modules fills the registry."""

from loadstone.plans.registry import ORACLES, QUERIES
from loadstone.plans import q_cleaning, q_drift, q_features, q_forecast, q_grid, q_insights, q_learn, q_sources, q_streaming, q_vintage, q_weather  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
