"""Telemetry evidence on Spark: decode, validate, identify, order and report
raw telemetry deliveries as DataFrame and Structured Streaming jobs."""
