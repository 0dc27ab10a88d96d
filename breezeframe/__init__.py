"""Hourly environmental analytics expressed as Spark DataFrame plans."""
