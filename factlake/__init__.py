"""Bi-temporal facts, hybrid retrieval and corpus work as PySpark DataFrame operators."""
