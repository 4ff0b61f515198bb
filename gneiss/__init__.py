"""Analytics for wide tables on Spark: profiling, binning, stability, ranking metrics and reports."""

__version__ = "0.1.0"
