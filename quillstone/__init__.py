"""A PySpark-native engine for document-grounded text data."""
