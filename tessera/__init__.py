"""A PySpark-native engine for curating, validating, splitting, scoring and benchmarking text records."""
