"""Telemetry and log text derived from the given tables, which hold no event logs."""
