"""Tidemark: a Spark-native market-data lakehouse and quantitative analytics engine."""

__version__ = "0.1.0"
