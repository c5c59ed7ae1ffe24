"""Spark-native analytics for imaging-based spatial transcriptomics."""
