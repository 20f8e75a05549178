"""Spark-native corpus ETL, profiling, metrics and feature preprocessing."""
