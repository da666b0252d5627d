"""Spark operators for keyed, possibly irregular energy and weather time series."""
