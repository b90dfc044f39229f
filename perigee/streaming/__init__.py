"""Structured Streaming: incremental loads and live telemetry."""
