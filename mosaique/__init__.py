"""mosaique: a Spark-native engine for media catalogs and embedding similarity."""

__version__ = "0.1.0"
