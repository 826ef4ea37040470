"""Portfolio analytics as DataFrame-to-DataFrame operators for Spark."""

__version__ = "0.1.0"
