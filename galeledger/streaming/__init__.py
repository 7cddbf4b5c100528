"""Structured Streaming form of the telemetry roll-up."""
