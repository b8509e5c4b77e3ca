"""Spark-native document-recognition analytics: DataFrame operators over page, region and text tables."""
