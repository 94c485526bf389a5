"""Spark-native event/raster dataset building and forecast verification."""
