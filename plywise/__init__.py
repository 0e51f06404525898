"""Spark-native analytics for model-versus-model game benchmarks."""
