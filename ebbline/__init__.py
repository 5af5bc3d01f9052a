"""A Spark-native event-analytics engine: composable ``DataFrame -> DataFrame`` operators."""

__version__ = "0.1.0"
