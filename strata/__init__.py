"""Spark-native analytics over coding-agent session logs."""
