"""Spark-native reconciliation and evaluation of structured data extracted from documents."""
