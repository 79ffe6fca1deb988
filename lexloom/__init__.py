"""Corpus analytics as composable PySpark DataFrame queries."""
