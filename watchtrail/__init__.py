"""Spark-native threat analytics over cloud audit logs."""
