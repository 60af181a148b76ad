"""Tidemark: customer-signal analytics as Spark DataFrame plans."""
