"""Security analytics over code, packages and developer telemetry, as Spark DataFrames."""

__version__ = "0.1.0"
