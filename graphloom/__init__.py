"""Spark-native analytics over code repositories, link graphs and text tables."""
