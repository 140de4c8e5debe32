"""Candela: technical-analysis and training-data operators as Spark DataFrame plans."""
