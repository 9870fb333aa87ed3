"""Spark-native document fidelity engine."""
