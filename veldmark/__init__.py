"""Veldmark: screening of supplier price deliveries, and preparation of training text, as Spark jobs."""
