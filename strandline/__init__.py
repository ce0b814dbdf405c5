"""strandline: window analytics over panels of time series, on Spark."""
