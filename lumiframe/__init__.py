"""lumiframe: a Spark-native engine for functional imaging time-series and training-data pipelines."""

__version__ = "0.1.0"
