"""plateview: opinion mining over very large review tables, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
