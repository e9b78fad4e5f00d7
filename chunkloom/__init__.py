"""Spark-native analytics over deduplicated, content-addressed snapshot catalogs."""
