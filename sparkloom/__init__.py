"""Spark-native analytics over sparse feature activations."""
