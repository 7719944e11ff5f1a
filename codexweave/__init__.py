"""codexweave: a Spark-native engine for text rescued from digitised books."""

__version__ = "0.1.0"
