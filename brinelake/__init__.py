"""Telemetry analytics as Spark jobs: mapping, keyed state, rollups and two-site reconciliation."""
