"""Structured Streaming forms of the telemetry and membership queries."""
