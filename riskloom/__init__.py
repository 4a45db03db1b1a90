"""Behaviour and fraud analytics on bank tables, as Spark DataFrame plans."""
