"""siftnet: Spark-native analytics over network security events."""

__version__ = "0.1.0"
