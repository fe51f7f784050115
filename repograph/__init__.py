"""repograph: source-code knowledge graphs and repository analytics on Spark."""

__version__ = "0.1.0"
