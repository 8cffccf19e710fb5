"""A PySpark-native engine for grounded question answering over document corpora."""
