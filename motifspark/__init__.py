"""Approximate pattern search over text columns, expressed as Spark DataFrame plans."""
