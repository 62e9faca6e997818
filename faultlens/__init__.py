"""faultlens: job-telemetry analytics expressed as Spark DataFrame jobs."""
