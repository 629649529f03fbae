"""Spark-native analytics over content-addressed, checkpointed file-version data."""
