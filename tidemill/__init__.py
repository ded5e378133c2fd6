"""A PySpark-native toolkit for tables and training corpora."""
