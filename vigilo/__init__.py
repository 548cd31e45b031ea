"""Equipment condition monitoring on Spark: telemetry to health indices, remaining-life bounds and decisions."""
