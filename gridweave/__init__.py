"""Gridweave: Spark-native analytics for interdependent infrastructure networks."""
