"""graphloom: a PySpark-native engine for text-to-knowledge-graph retrieval."""

__version__ = "0.1.0"
