"""tallyspark: analytics operators as Spark SQL and DataFrame plans."""

__version__ = "0.1.0"
