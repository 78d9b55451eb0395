"""Spark-native analytics over per-position sequence data."""
