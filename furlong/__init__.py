"""Grouped-choice events on Spark: point-in-time features, forecasts, scoring."""
