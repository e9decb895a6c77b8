"""Strandfold: Spark-native analytics for reads that carry unique molecular identifiers."""
