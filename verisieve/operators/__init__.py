"""Operators on DataFrames: extraction, lookup joins, scoring, telemetry, evaluation, documentation."""
