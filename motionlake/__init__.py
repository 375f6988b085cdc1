"""Motion time-series analytics on Spark: DataFrame operators over landmark tables."""

__version__ = "0.1.0"
