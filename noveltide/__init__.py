"""noveltide: one-class anomaly analytics and table processing on PySpark."""

__version__ = "0.1.0"
