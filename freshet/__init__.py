"""freshet: a Spark-native streaming feature engine."""

__version__ = "0.1.0"
