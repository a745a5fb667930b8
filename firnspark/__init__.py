"""Analytics for time series, rasters and sample tables on Spark."""
