"""Spark-native cleaning, reconciliation, publishing and search of public funding records."""
