"""A PySpark-native engine for text extraction, scoring and training data."""
