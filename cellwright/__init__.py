"""cellwright: a Spark-native engine for data on a hierarchical equal-area spherical grid."""

__version__ = "0.1.0"
