"""Spark-native endpoint-telemetry detection analytics.

Everything here is a DataFrame-in, DataFrame-out operator: normalization, rule
evaluation, sequence matching, anomaly scoring, response planning, evaluation
and coverage roll-ups, plus Structured Streaming variants of the stateful ones.
"""
