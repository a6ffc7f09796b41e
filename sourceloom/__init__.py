"""Verified knowledge analytics expressed as Spark DataFrame plans."""
