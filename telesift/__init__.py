"""Spark jobs that find anomalies in large multichannel sensor telemetry."""
