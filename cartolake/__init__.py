"""Spark-native geospatial styling and spatial analytics."""
