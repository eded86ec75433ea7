"""Event studies and pattern research on market time series, as Spark DataFrame operators."""
