"""Time-series preparation, features and forecasting as Spark DataFrame jobs."""

__version__ = "0.1.0"
