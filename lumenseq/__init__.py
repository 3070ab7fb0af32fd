"""Spark-native operators for strain-level sequence reconstruction and its evaluation."""
