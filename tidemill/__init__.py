"""Spark-native cleansing, reconciliation and corpus-preparation operators."""
