"""Network-telemetry analytics as plain PySpark ``DataFrame -> DataFrame`` functions."""
