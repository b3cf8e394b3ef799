"""A PySpark-native analytics engine for spatial and sparse-matrix data."""
